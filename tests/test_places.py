"""Places in texts against all pairs by edit distance; a large table of places."""

import random

from fieldloom.operators import places

PLACES = ["Tunis", "Sfax", "Sidi Bouzid", "Menzel Temime", "Béja", "القيروان", "منزل تميم", "Ain Draham", "Tunis", " ", None]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fold(text):
    return text.lower().replace("é", "e").strip()


def plain(texts, table, labels):
    known, out = {}, {}
    for p in sorted({p for p in table if p and p.strip()}):
        known.setdefault(fold(p), p)
    for doc, text in texts:
        words = [w for w in fold(text or "").replace(":", " ").split() if w]
        found = []
        for k in (1, 2):
            for i in range(len(words) - k + 1):
                run = " ".join(words[i : i + k])
                near = any(w in labels for w in words[max(i - 3, 0) : i] + words[i + k : i + k + 1])
                for form, p in known.items():
                    n = edit(run, form)
                    if n == 0 or (n == 1 and len(form) >= 5 and len(run) >= 4):
                        found.append((not near, -k, n, i, p))
        if found:
            best = min(found)
            out[doc] = (best[4], best[2], not best[0])
    return out


def test_lookup_is_all_pairs(spark):
    r = random.Random(5)
    letters = "abtunisfx el"
    texts = [(i, " ".join(r.choice(["tuniss", "tnis", "sfa", "sfax", "menzel", "temime", "temim", "sidi", "bouzd", "beja", "ain", "lieu:", "draham", "القيروان", "القيوان", "منزل", "تميم", "".join(r.choices(letters, k=5))]) for _ in range(r.randrange(9)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "Lieu Sfax puis Tunis"), (1002, "Lieu Sfax puis Tunis")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, raw_text string, form string")
    table = spark.createDataFrame([(p, 1) for p in PLACES], "place string, run int")
    want = plain(texts, PLACES, ["lieu"])
    for small in (places.BROADCAST_BYTES, 0):
        got = {x.doc_id: (x.place, x.edits, x.labelled) for x in places.place_lookup(docs, table, ["lieu"], small=small).collect()}
        assert got == want
    assert places.place_lookup(docs.limit(0), table).collect() == [] and places.place_lookup(docs, table.limit(0)).collect() == []


def test_a_hundred_thousand_places(spark):
    """The keys are too many to broadcast; the runs of all documents are looked up once each."""
    table = spark.range(100_000).selectExpr("concat('ville ', translate(cast(id * 1000003 as string), '0123456789', 'bcdfghjkmn')) as place")
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('vers Ville ', translate(cast(id * 37 * 1000003 as string), '0123456789', 'bcdfghjkmn'), if(id % 2 = 0, 'z', ''), ' demain') as raw_text")
    got = places.place_lookup(docs, table).collect()
    assert len(got) == 2000
    letters = str.maketrans("0123456789", "bcdfghjkmn")
    assert all(r.place == "ville " + str(r.doc_id * 37 * 1000003).translate(letters) and r.edits == (r.doc_id % 2 == 0) for r in got if r.doc_id)
