import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, containment
from tickloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_decontamination", "op6_chat_format", "op7_quality_rules"])
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), c.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def grams(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_containment_by_loops(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[:30])
    items = [(1, item), (2, " ".join(words[50:56])), (3, "short one"), (4, ""), (5, None), (None, " ".join(words[100:140])), (1_000, " ".join(words[200:300]))]
    docs = [(1, " ".join(words)), (2, item), (2, item), (3, " ".join([*words[:13], "x", *words[14:30]])), (4, " ".join([*words[:13], "x", *words[14:20], "y", *words[21:30]])), (5, "Short, ONE!"), (6, "a short one here"), (7, None), (8, ""), (None, item.upper()), (9, "z " * 20_000 + item + " q" * 20_000), (10, " ".join(words[205:300]))]
    want = sorted((repr(i), repr(k), len(grams(t) & grams(x)), len(grams(x))) for i, t in set(docs) for k, x in items if grams(x) and 5 * len(grams(t) & grams(x)) >= 4 * len(grams(x)))
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, words string, n_shared int")
    b = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, needed string")
    for rows in (containment.BROADCAST_ROWS, 0):  # the sketches broadcast, and shuffled
        monkeypatch.setattr(containment, "BROADCAST_ROWS", rows)
        got = containment.contaminated(d, b)
        assert sorted((repr(r.doc_id), repr(r.item_id), r.n_shared, r.n_shingles) for r in got.collect()) == want
    assert containment.contaminated(d.limit(0), b).count() == 0 and containment.contaminated(d, b.limit(0)).count() == 0
    clean = containment.keep_clean(d, b)
    hit = {i for i, *_ in want}
    assert clean.columns == d.columns and sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(i) for i, _ in docs if repr(i) not in hit)


def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[TURN][\\TURN]", "[ROLE]x[/ROLE]", "", None, "🙂 é", "<s", "s>", "<", "[INST", "\n <s>\n", "$1 \\$1"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "assistant", "system", None, "t<s>ool", "user"))]
    rows += [(2, 0, "assistant", "only"), (3, None, "user", "null turn"), (3, 1, "user", "b"), (3, 1, "user", "a"), (None, 0, "user", "x"), (4, 0, None, None)]
    rows += [(5, i, ("user", "assistant")[i % 2], "t" * (i % 7)) for i in range(1500)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, turns string, loss int")
    read = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    assert set(read) == {r[0] for r in rows}
    for key, r in read.items():
        turns = sorted(((-1 if n is None else n, role or "", t or "") for c, n, role, t in rows if c == key), key=lambda x: (x[0], x[1], x[2]))
        if key == 1:
            turns = sorted(turns, key=lambda x: x[0])
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in turns]
        assert r.loss_text == "".join(t for _, role, t in turns if role == "assistant") and len(r.loss) == sum(role == "assistant" for _, role, _ in turns)
    assert read[5].formatted.startswith("<s>[INST]  [/INST]<s>t</s>") and hashlib.sha256(read[2].formatted.encode()).hexdigest() == hashlib.sha256(b"<s>only</s>").hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def test_keep_clean_with_clashing_columns(spark):
    """Columns of the documents may have any name, those that the operator uses inside as well."""
    said = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, said), (2, "something else that is clean enough"), (None, said), (None, "clean")], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_found", "of", "item", "h", "n")})
    items = spark.createDataFrame([(9, said)], "item_id long, text string")
    kept = containment.keep_clean(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
