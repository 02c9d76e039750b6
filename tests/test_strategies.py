"""Strategies as data against a plain walk over them."""

import random
import re

from fieldloom.operators import strategies

KEYS = [x.split()[0] for x in strategies.STRATEGY.split(", ")]


def walk(doc: dict, steps: list[dict]):
    for s in sorted(steps, key=lambda s: s["rank"]):
        texts = [t for t in doc["texts"] or [] if t is not None]
        region = ((doc["regions"] or {}).get(s["region"]) or "").strip()
        texts = [region] * bool(region) + texts
        found, kind = None, s["kind"]
        if kind == "known":
            found = (doc["known"] or {}).get(s["source"] or s["field"])
        elif kind == "constant":
            found = s["source"]
        elif kind == "first_line":
            found = next((x for t in texts for x in re.split(r"\r\n|\r|\n", t) if x.strip()), None)
        elif kind in ("pattern", "anchor"):
            for t in texts:
                if kind == "anchor":
                    if s["anchor"] not in t:
                        continue
                    t = t[t.index(s["anchor"]) :][: s["width"]]
                    if s["pattern"] is None:
                        found = t.replace(s["anchor"], "")
                        break
                hit = re.search(s["pattern"], t)
                if hit and hit.group(s["part"]).strip():
                    found = hit.group(s["part"])
                    break
        if found and found.strip():
            return found.strip(), s["rank"]
    return None, None


def test_strategies_are_a_plain_walk(spark):
    r = random.Random(5)
    kinds = ["known", "pattern", "anchor", "anchor", "first_line", "constant", "unheard"]
    rules = []
    for template in "ABC":
        for field in "xyz":
            for rank in range(1, r.randint(2, 5)):
                kind = r.choice(kinds)
                pattern = r.choice([r"no (\d+)", r"(\w+) end", r"=\s*(\S*)"]) if kind == "pattern" or r.random() < 0.5 else None
                rules.append((template, field, rank, kind, pattern, r.choice([0, 1]), r.choice(["no", "name:", "="]), r.choice([5, 9, 30]), r.choice([None, "y", " "]), r.choice([None, "top", "low"])))
    words = ["no 12", "name: Ada", "=", "= b", "an end", "\n", "  ", "\r\n", "عمر"]
    text = lambda: r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randint(1, 9)))])
    docs = []
    for i in range(300):
        regions = r.choice([None, {"top": text()}, {"low": text(), "top": None}])
        docs.append((r.choice([i, i, None]), r.choice(["A", "B", "C", "D", None]), r.choice([None, [], [text()], [text(), text()]]), regions, r.choice([None, {"x": " k "}, {"y": ""}])))
    docs += docs[:5]
    names = ["doc_id", "template_id", "texts", "regions", "known"]
    schema = "doc_id long, template_id string, texts array<string>, regions map<string,string>, known map<string,string>"
    steps = [dict(zip(KEYS, x, strict=True)) for x in rules]
    want = []
    for d in (dict(zip(names, x, strict=True)) for x in docs):
        for field in "xyz":
            mine = [s for s in steps if s["template_id"] == d["template_id"] and s["field"] == field]
            if mine:
                want.append((d["doc_id"], field, *walk(d, mine)))
    strategy = spark.createDataFrame(rules, strategies.STRATEGY)
    given = spark.createDataFrame([(*d, "extra") for d in docs], schema + ", field string")
    got = [tuple(x) for x in strategies.strategy_fields(given, strategy).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({w[3] for w in want}) > 3
    assert strategies.strategy_fields(given.limit(0), strategy).count() == 0
    assert strategies.strategy_fields(given, strategy.limit(0)).count() == 0
