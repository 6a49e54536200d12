import math
import re
from collections import Counter

from tickloom.llm import quality
from tickloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def classes(text):
    import unicodedata

    out = [0] * 7
    for c in text:
        kind = unicodedata.category(c)
        out[0 if kind == "Ll" else 1 if kind == "Lu" else 2 if kind == "Nd" else 3 if c in SPACES else 4 if c in ".,;:!?'()\"-" else 5 if c in "#*$%&|<>" else 6] += 1
    return out


def letters(text):
    return [w for w in re.split(r"[\W\d_]+", text.lower()) if w]


def js(p, q):
    term = lambda a, b: (a * math.log2(2 * a / (a + b)) if a > 0 else 0) + (b * math.log2(2 * b / (a + b)) if b > 0 else 0)
    return math.sqrt(max(0.0, sum(map(term, p, q)) / 2))


def plain(docs):
    """(id, base counts, failed, kept) of (id, text, language), by loops."""
    chars, words = {}, {}
    for _, t, lang in docs:
        key, t = lang or "", t or ""
        chars[key] = [a + b for a, b in zip(chars.get(key, [0] * 7), classes(t), strict=True)]
        words.setdefault(key, Counter()).update(letters(t))
    out = []
    for i, t, lang in docs:
        key, counts = lang or "", base(t)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        total = sum(words[key].values())
        kept = not failed
        if kept and total >= quality.LEAST_REFERENCE:
            common = {w: n / total for w, n in words[key].items() if n / total >= quality.COMMON}
            mine, own = Counter(letters(t)), letters(t)
            p = [mine[w] / max(1, len(own)) for w in common]
            kept = js([*p, 1 - sum(p)], [*common.values(), 1 - sum(common.values())]) <= quality.FAR_WORDS + quality.NOISE / math.sqrt(counts[0])
            c, r = classes(t), chars[key]
            kept = kept and js([x / sum(c) for x in c], [x / sum(r) for x in r]) <= quality.FAR_CHARS
        out.append((str(i), *counts, failed, kept))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in df.collect())


def test_edge_cases(spark):
    docs = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "a b c a b c", "en"), (4, "a b c a b c", "en"), (None, "x", None), (5, "one two\n\none two\none  two\n \n ", "en"), (6, "ab cd ef " * 9000, "en"), (7, "#*$%&|<> é🙂 日本", "xx"), (8, " ".join(f"word{i} of the" for i in range(900)), "en"), (9, "%%% " * 100 + "a b c", "en"), (10, "a a a a", "en")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, kept string, n_words int")
    assert found(quality.quality(df)) == plain(docs)
    assert quality.quality(df.limit(0)).count() == 0
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, *_, k in plain(docs) if k)


def test_query_against_loops(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert found(QUERIES["op7_quality_rules"](spark, SF)) == plain([(r.doc_id, r.text, r.lang) for r in rows])
