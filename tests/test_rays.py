import math
import random

from sugarmill.operators import linking


def meets(p, q, a, b):
    det = (q[0] - p[0]) * (b[1] - a[1]) - (q[1] - p[1]) * (b[0] - a[0])
    if det == 0:
        return False
    t = ((a[0] - p[0]) * (b[1] - a[1]) - (a[1] - p[1]) * (b[0] - a[0])) / det
    u = ((a[0] - p[0]) * (q[1] - p[1]) - (a[1] - p[1]) * (q[0] - p[0])) / det
    return 0 <= t <= 1 and 0 <= u <= 1


def every_step(monos, lines, distance):
    """Links by trying all 40 steps of every ray."""
    links = set()
    for i, x, y, w, h in monos:
        m = (x + w // 2, y + h // 2)
        r = int(math.sqrt(h * h + w * w) / 2 * 1.5)
        for cx, cy in lines:
            if not (max(m[0] - r, 0) <= cx <= min(m[0] + r, 640) and max(m[1] - r, 0) <= cy <= min(m[1] + r, 400)):
                continue
            length = max(math.sqrt((m[0] - cx) ** 2 + (m[1] - cy) ** 2), 1.0)
            best = None
            for step in range(1, 200, 5):
                q = (int(cx + (cx - m[0]) / length * (distance * (step / 100))), int(cy + (cy - m[1]) / length * (distance * (step / 100))))
                for j, ox, oy, ow, oh in monos:
                    c = [(ox, oy), (ox + ow, oy), (ox + ow, oy + oh), (ox, oy + oh)]
                    if j != i and best is None and any(meets(m, q, c[k], c[(k + 1) % 4]) for k in range(4)):
                        best = j
                if best is not None:
                    links.add((min(i, best), max(i, best)))
                    break
    return links


def test_few_steps_find_what_all_steps_find(spark):
    r = random.Random(7)
    monos, lines, distances, want = [], [], [], set()
    for image in range(60):
        size = (2, 60) if image % 3 else (0, 5)  # some boxes are too small to be hit surely, some overlap or hold each other's centre
        own = [(k, r.randrange(600), r.randrange(360), r.randint(*size), r.randint(*size)) for k in range(8)]
        own.append((8, own[0][1], own[0][2], own[0][3], own[0][4]))
        con = [(x + w // 2 + r.randint(-40, 40), y + h // 2 + r.randint(-40, 40)) for _, x, y, w, h in own] + [(own[1][1] + own[1][3] // 2, own[1][2] + 9)]
        distance = r.uniform(5, 300)
        monos += [(image, *m, 640, 400, m[1] + m[3] // 2, m[2] + m[4] // 2) for m in own]
        lines += [(image, k, *c) for k, c in enumerate(con)]
        distances.append((image, distance))
        want |= {(image, *e) for e in every_step(own, con, distance)}
    m = spark.createDataFrame(monos, "image_id long, mono_idx long, x int, y int, w int, h int, imwidth int, imheight int, cen_x int, cen_y int")
    got = linking.ray_links(m, spark.createDataFrame(lines, "image_id long, contour_idx long, cx int, cy int"), spark.createDataFrame(distances, "image_id long, distance double"))
    found = {tuple(x) for x in got.collect()}
    assert found - want == set() and want - found == set() and len(want) > 60
