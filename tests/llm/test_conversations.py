"""Chat formatting and the prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given as given_texts
from hypothesis import settings
from hypothesis import strategies as st

from fieldloom.llm import chat_format, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, path string, depth int"


def case_rows(seed=1, most=900):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, most, 3), 1200, 1201, 1205]:
        kind = r.randrange(4)
        for t in range(r.choice([1, 2, 3, 3, 4, 5, 9, 17, 40])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"t{kind if r.random() < 0.9 else r.randrange(5)} {t}"))
    odd = [(None, 1, "user", "b"), (None, None, None, "c"), (2000, None, None, None), (2000, 1, "assistant", "é\U0001f600"), (2001, 0, "x", ""), (2002, 0, "user", "r"), (2002, 0, "user", "r")]
    return [(*row, "k", 1, "p", 2) for row in rows + odd]


def by_conversation(rows):
    found = defaultdict(list)
    for c, t, role, text, *_ in rows:
        found[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in found.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    convs = {c: v for c, v in by_conversation(rows).items() if c is not None}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members, children, below = defaultdict(list), defaultdict(list), {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below[node] = (sum(below[c][0] for c in children[node]) or 1, saved + sum(below[c][1] for c in children[node]))
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *below[node], sha(ends)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("first", "growth"), [(4096, 16), (20, 5)])
def test_trie_is_the_plain_one(spark, first, growth):
    rows = case_rows()
    paths = prefix_trie.chained(prefix_trie.with_shared_heads(prefix_trie.conversations(spark.createDataFrame(rows, SCHEMA))))
    got = prefix_trie.trie_nodes(paths, first, growth)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_chains_copies_and_turnless(spark):
    """Every prefix of one conversation, many copies, ids of any size; 8 has nothing but turns that its absent head would replace."""
    rows = [(10**15 + 100 * k, t, "user", f"turn {t}") for k in range(1, 40) for t in range(k)]
    rows += [(-7 - c, t, "a", f"same {t}") for c in range(300) for t in range(7)] + [(8, 0, "user", "gone")]
    assert zlib.crc32(b"8") % 6 > 0
    rows = [(*row, "k", 1, "p", 2) for row in rows]
    paths = prefix_trie.chained(prefix_trie.conversations(spark.createDataFrame(rows, SCHEMA)))
    plain = {c: tuple(v) for c, v in by_conversation(rows).items()}
    got = {(r.depth, r.conv_id): r for r in prefix_trie.trie_nodes(paths, 8, 2).collect()}
    members = defaultdict(list)
    for c, s in plain.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    assert len(got) == len(members)
    for node, m in members.items():
        r = got[len(node), min(m)]
        assert r.n_convs == len(m)
        assert r.ends_sha256 == sha(",".join(map(str, sorted(c for c in m if plain[c] == node))))


def test_trie_of_nothing_and_of_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie_nodes(prefix_trie.chained(prefix_trie.with_shared_heads(prefix_trie.conversations(none)))).collect() == []
    one = spark.createDataFrame([(8, 0, "user", "gone", "k", 1, "p", 2)], SCHEMA)
    got = prefix_trie.trie_nodes(prefix_trie.chained(prefix_trie.with_shared_heads(prefix_trie.conversations(one)))).collect()
    assert [tuple(r) for r in got] == [(8, 0, None, 1, 0, 1, 0, sha("8"))]


def test_trie_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_prefix_trie(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


TEXTS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\n\nb<|", "", "<|im_start|>"]), st.text("<|\\im_startend>\n aé", max_size=40)), max_size=6)


@settings(max_examples=300, deadline=None)
@given_texts(TEXTS)
def test_marks_read_back(turns):
    assert chat_format.read_turns(chat_format.marked_turns(turns)) == turns
    samples = chat_format.located(turns, chat_format.marked_turns, "assistant".__eq__)
    assert len(samples) == 1 and samples[0]["formatted"] == chat_format.marked_turns(turns)
    learnt = [chat_format.unescape(samples[0]["formatted"][x["start"] : x["end"]]) for x in samples[0]["loss"]]
    assert learnt == [text for role, text in turns if role == "assistant"]


def test_chat_query_is_the_plain_rendering(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.CONTROL_TURNS
    got = {r.conv_id: r for r in queries.op12_chat_formatting(spark, sf_dir).collect()}
    convs = by_conversation(rows)
    assert set(got) == set(convs)
    for c, turns in convs.items():
        learnt = [x for role, x in turns if role == "assistant"]
        want = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), sum(map(len, learnt)), sha("".join(learnt)))
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
        assert got[c].formatted_chars == len(chat_format.marked_turns(turns))


def test_chat_cases(spark):
    rows = case_rows(most=30)
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in chat_format.format_conversations(table).collect()}
    for c, turns in by_conversation(rows).items():
        assert got[c].formatted == chat_format.marked_turns(turns)
        assert [s.role for s in got[c].spans] == [r for r, _ in turns]
        assert got[c].spans[-1].end == len(got[c].formatted)
    assert chat_format.digests(chat_format.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def forgetful(turns):
    """Drops what stands in <think> from all but the last turn, as templates of reasoning models do."""
    out = "S\n"
    for i, (role, text) in enumerate(turns):
        if i < len(turns) - 1 and "</think>" in text:
            text = text.split("</think>")[1]
        out += f"[{role}]{text}\n"
    return out


def test_rewritten_history_is_found(spark):
    turns = [("user", "q1"), ("assistant", "<think>x</think>a1"), ("user", "q2"), ("assistant", "a2")]
    rows = [(1, i, *t, "k", 1, "p", 2) for i, t in enumerate(turns)]
    got = sorted(chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA), forgetful).collect(), key=lambda r: r["sample"])
    assert [r.formatted for r in got] == [forgetful(turns[:2]), forgetful(turns)]
    assert got[0].rewritten_at == len("S\n[user]q1\n[assistant]") and got[1].rewritten_at is None
    assert [[r.formatted[x.start : x.end] for x in r.loss] for r in got] == [["<think>x</think>a1"], ["a2"]]
    assert [s.turn for s in got[1].spans] == [0, 2, 3]


def trimming(turns):
    return "".join(f"{role}: {text.strip()}</s>" for role, text in turns)


def test_texts_that_the_template_changes_are_still_located():
    one = chat_format.located([("assistant", "  padded "), ("user", "u")], trimming, "assistant".__eq__)[0]
    assert one["formatted"][one["loss"][0]["start"] : one["loss"][0]["end"]] == "padded"
