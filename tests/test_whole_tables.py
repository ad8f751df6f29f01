"""Registered queries without SQL see every row of their table."""

import itertools
import random
from collections import defaultdict

from ensemblake.plans import q_space


def brute_pockets(points, spacing, reach, least):
    """(frame, x, y, z): cluster, by loops over cells, lines and pairs."""
    out = {}
    for frame in sorted({p[0] for p in points}):
        own = [p[1:] for p in points if p[0] == frame]
        low = [min(c) for c in zip(*own, strict=True)]
        n = [-int(-(max(c) - lo) // spacing) for c, lo in zip(zip(*own, strict=True), low, strict=True)]
        cells = list(itertools.product(*(range(k + 1) for k in n)))
        place = {c: [lo + k * spacing for k, lo in zip(c, low, strict=True)] for c in cells}
        touch = {c: any(sum((a - b) ** 2 for a, b in zip(place[c], p, strict=True)) < reach**2 for p in own) for c in cells}
        rank = dict.fromkeys(cells, 0)
        mx, my = n[0], n[1]
        axes = [(lambda c, k=k: tuple(v for j, v in enumerate(c) if j != k), k) for k in range(3)]
        turned = [(lambda c, a=a, b=b: ((mx - c[0] if a else c[0]) - c[2], (my - c[1] if b else c[1]) - c[2]), 2) for a in (0, 1) for b in (0, 1)]
        for number, (line, order) in enumerate(axes + turned):
            hit = defaultdict(list)
            for c in cells:
                if touch[c]:
                    hit[line(c)].append(c[order])
            for c in cells:
                at = line(c)
                skipped = number >= 3 and at[0] == at[1] < 0
                rank[c] += bool(not touch[c] and not skipped and hit[at] and min(hit[at]) < c[order] < max(hit[at]))
        left, groups = {c for c in cells if rank[c] >= least}, []
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                c = todo.pop()
                group.add(c)
                near = {o for o in left if sum((a - b) ** 2 for a, b in zip(c, o, strict=True)) <= 1.5**2}
                left -= near
                todo += near
            groups.append(group)
        name = lambda c: ",".join(map(str, (frame, *c)))  # noqa: B023, E731
        groups.sort(key=lambda g: (-len(g), min(map(name, g))))
        out |= {(frame, *c): k for k, g in enumerate(groups) for c in g}
    return out


def test_pocket_clusters_take_every_frame(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, k % 6, [rng.uniform(-0.25, 0.25) for _ in range(18)]) for k in range(6 * 30)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.frame, r.x, r.y, r.z): r.cluster for r in q_space.Q["pocket_clusters"][0](spark, str(tmp_path)).collect()}
    want = brute_pockets([(f, *(round(x * 10, 4) for x in v[:3])) for _, f, v in rows], 1.0, 0.7, 2)
    assert got == want and {f for f, *_ in got} == set(range(6))


def test_excitations_of_every_event(spark, tmp_path):
    spark.range(3000).selectExpr("id * 7 AS event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = q_space.Q["resolve_excitations"][0](spark, str(tmp_path)).collect()
    assert sorted(r.sample_id for r in got) == [7 * k for k in range(3000)]
    n = {k: sum(r.outcome == k for r in got) for k in ("radiative", "non_radiative", "energy_transfer")}
    assert sum(n.values()) == 3000 and 9 < n["radiative"] / n["non_radiative"] < 14 and min(r.lifetime for r in got) > 0
