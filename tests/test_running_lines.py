"""Lines by running means against the plain rule: the first line whose mean is near takes the box."""

import random
from statistics import median

from fieldloom.operators import boxes


def walk(rows: list[tuple]) -> dict:
    rows = sorted((r for r in rows if r[4] > r[2] and r[5] > r[3]), key=lambda r: ((r[3] + r[5]) / 2, r[2], r[1]))
    tolerance = max(12.0, 0.75 * median([r[5] - r[3] for r in rows])) if rows else 0
    lines: list[list] = []
    for r in rows:
        cy = (r[3] + r[5]) / 2
        for line in lines:
            if abs(cy - sum(c for c, _ in line) / len(line)) <= tolerance:
                line.append((cy, r[1]))
                break
        else:
            lines.append([(cy, r[1])])
    return {idx: k for k, line in enumerate(sorted(lines, key=lambda x: sum(c for c, _ in x) / len(x))) for _, idx in line}


def test_running_lines_are_the_plain_rule(spark):
    r = random.Random(3)
    rows = []
    for doc in range(40):
        slant = r.choice([0, 0.05, 0.2, 0.5])
        for i in range(r.randint(1, 120)):
            x, height = r.randrange(600), r.choice([0, 10, 14, 30, 60]) if doc % 3 else 14
            y = float(r.randrange(8) * 25) + slant * x
            rows.append((doc, i, float(x), y, float(x + r.choice([0, 20, 40])), y + height, f"w{i}"))
    given = spark.createDataFrame(rows + [(None, 1, 0.0, 0.0, 5.0, 5.0, "lost")], "doc_id long, idx long, x1 double, y1 double, x2 double, y2 double, text string")
    got = {(x.doc_id, x.idx): x.line_no for x in boxes.running_lines(given).collect()}
    want = {(doc, idx): line for doc in range(40) for idx, line in walk([x for x in rows if x[0] == doc]).items()}
    assert got == want and max(want.values()) > 8
    steps = {(x.doc_id, x.idx): x.line_no for x in boxes.cluster_lines(given.filter("doc_id is not null")).collect()}
    assert steps != want
    assert boxes.running_lines(given.limit(0)).count() == 0
    texts = boxes.reading_order(given, lines=boxes.running_lines)
    assert texts.count() == len({(d, n) for (d, _), n in want.items()})


def test_running_lines_keep_a_box_of_many_in_one_walk(spark):
    page = spark.range(100_000).selectExpr("1L as doc_id", "id as idx", "cast(id % 100 as double) as x1", "cast(id div 100 * 20 as double) as y1", "cast(id % 100 + 5 as double) as x2", "cast(id div 100 * 20 + 10 as double) as y2", "'w' as text")
    got = boxes.running_lines(page).groupBy("line_no").count().collect()
    assert len(got) == 1_000 and {x["count"] for x in got} == {100}
