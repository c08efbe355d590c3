"""Conversation repair against a plain program over rows and states that carries the audits."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sojourn.llm import conversations, queries

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_repair(rows):
    """rows: (role, text, must_go, cut_off) in order -> (cost, audit, repaired), every way tried."""
    goes = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    table = [None] * (len(rows) + 1)
    for k in range(len(rows), -1, -1):
        best = {s: ((0, "", ()) if k == len(rows) and s in ("", "a") else (10 ** 9, "", ())) for s in ("", "s", "u", "a")}
        if k < len(rows):
            role, text, must_go, cut = rows[k]
            for s in best:
                c, a, r = table[k + 1][s]
                ways = [(c + 4, "D" + a, r)]
                if not must_go:
                    for new, cost, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                        if to := goes.get((s, new[:1])):
                            c, a, r = table[k + 1][to]
                            ways.append((c + cost + 3 * cut, edit + a, ((new, text), *r)))
                best[s] = min(ways, key=lambda w: w[:2])
        for _ in range(4):  # insertions before the row
            for s in best:
                for new in ("user", "assistant"):
                    if to := goes.get((s, new[0])):
                        c, a, r = best[to]
                        best[s] = min(best[s], (c + 3, "I" + a, ((new, ""), *r)), key=lambda w: w[:2])
        table[k] = best
    return table[0][""]


def brute_conversation(conv, rows):
    """Row of the query for one conversation: rows of (turn, role, text) after the damage."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not rows:
        return (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    seen, told, marked = set(), [0, 0, 0], []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        if fault is not None:
            told[fault] += 1
        seen.add((role, text))
        marked.append((role, text, fault in (0, 1), fault == 2))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, repaired = brute_repair(marked)
    return (conv, gaps, *told, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        conv_, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        code = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if code == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if code == 2 else text
        out[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def as_set(df):
    return {tuple(r) for r in df.collect()}


def a_conversation(rnd, conv):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why?", "and then", "Same text."]
    n = rnd.choice([0, 1, 2, 5, 30])
    turns = sorted(rnd.sample(range(60), n))
    return [(conv, rnd.choice([t, t, t, None]) if k == 0 else t, rnd.choice(roles), rnd.choice(texts) if rnd.random() < .6 else f"Text {k}.")
            for k, t in enumerate(turns)]


@pytest.mark.parametrize("seed", range(30))
def test_choices_equal_the_plain_program(seed):
    rnd = random.Random(seed)
    for _ in range(30):
        symbols = [rnd.choice(["s", "u", "a", "?", "u!", "a!", "-"]) for _ in range(rnd.randrange(0, 9))]
        symbols = [s for s in symbols for _ in range(rnd.choice([1, 1, 3]))]
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(s[0], "tool"), "t", s == "-", s.endswith("!")) for s in symbols]
        cost, audit, _ = brute_repair(rows)
        assert conversations.unroll(symbols, 0, conversations.END, True)[:2] == (audit, cost)
        assert conversations.apply(conversations.matrix(symbols), conversations.END)[0] == cost


def test_query_equals_brute_force_on_the_given_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {brute_conversation(c, r) for c, r in brute_damage(rows).items()}
    assert as_set(queries.op12_conversation_repair(spark, sf)) == want


@pytest.mark.parametrize("segment_rows", [1, 2, 7, 1024])
def test_any_cut_into_segments_gives_the_same(spark, segment_rows):
    rnd = random.Random(segment_rows)
    rows = [r for conv in [*range(25), None] for r in a_conversation(rnd, conv)]
    rows += [(99, k // 3, rnd.choice(["user", "assistant"]), f"Hot {k % 50}.") for k in range(600)]  # a third of all and more
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(rest)
    # rows of conversation 99 with one turn: any order of roles and texts is that of brute_conversation
    assert as_set(conversations.summary(conversations.repair(df, segment_rows))) == {brute_conversation(c, r) for c, r in by.items()}
    damaged = as_set(conversations.repaired_after_damage(df, segment_rows))
    assert damaged == {brute_conversation(c, r) for c, r in brute_damage(rows).items()}


def test_equal_rows_in_one_turn_and_conversations_without_rows(spark):
    rows = [(1, 5, "user", "Hi.")] * 40 + [(2, 0, None, None), (3, None, "assistant", "Only."), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("x")).withColumn("key", F.lit(1)).withColumn("open", F.lit(1))
    got = {r["conv_id"]: r for r in conversations.summary(conversations.repair(df, 3)).collect()}
    assert (got[1]["duplicate"], got[1]["cost"], got[1]["audit"]) == (39, 39 * 4 + 3, "K" + "D" * 39 + "I")
    assert (got[2]["blank"], got[2]["audit"], got[2]["cost"]) == (1, "D", 4)
    assert (got[3]["gaps"], got[3]["audit"], got[3]["cost"]) == (0, "IK", 3) and got[None]["blank"] == 1
    assert as_set(conversations.repaired_after_damage(df.where(F.lit(False)))) == set()


def test_real_outputs(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Anyone?"), (1, 2, "tool", "Yes.")]
    piece = conversations.repair(spark.createDataFrame(rows, SCHEMA)).first()
    cost, audit, repaired = brute_repair([(r, t, False, False) for _, _, r, t in rows])
    assert (piece["cost"], piece["audit"], tuple(tuple(r) for r in piece["repaired"])) == (cost, audit, repaired)
