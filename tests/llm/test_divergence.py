"""The source divergence audit against plain loops."""

import re
from collections import Counter

from pyspark.sql import functions as F

from turnweave.llm import divergence_cube
from turnweave.llm.divergence_cube import divergence_audit, terms_of

DOCS = "doc_id long, text string, lang string, source string"


def brute(rows, least, most):
    texts = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for _, t, l, s in rows]
    low = {ord("A") + k: ord("a") + k for k in range(26)}
    texts = [(l, s, [w.translate(low) for w in found]) for l, s, found in texts]
    out = set()
    for lang in {l for l, _, _ in texts}:
        docs = Counter(w for l, _, found in texts if l == lang for w in set(found))
        vocabulary = {w for w, n in docs.items() if n >= least}
        size = len(vocabulary)

        def shares(chosen):
            counts = Counter(w for l, s, found in texts if l == lang and chosen(s) for w in found if w in vocabulary)
            total = sum(counts.values())
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * size) for w in vocabulary}, counts

        whole, _ = shares(lambda s: True)
        sources = {s for l, s, _ in texts if l == lang}
        own = {source: shares(lambda s, source=source: s == source) for source in sources}
        for source, (p, counts) in own.items():
            pairs = [(sum(abs(p[w] - q[w]) for w in vocabulary), s) for s, (q, _) in own.items() if s != source]
            terms = [(p[w] - whole[w], w) for w in vocabulary if counts[w] and p[w] > whole[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found[: None if part == "pair" else most], 1):
                    out.add((lang, source, part, item, value, rank))
    return out


def rows_for(seed, count=120):
    words = ["Apple", "banana", "ÉTÉ", "été", "中文", "x", "Zoo", "mid-dle", "a1b", "𝔘nicode", "tail"]
    rows = []
    for k in range(count):
        chosen = [words[(k * 7 + j * (k % 5 + 1) + seed) % len(words)] for j in range(k % 9)]
        rows.append((k, " ".join(chosen), ("en", "de", None, "")[k % 7 % 4], ("big", "a", "b", "é", None, "z")[min(k % 11, 5) if k % 3 else 0]))
    rows += [(1, None, "en", "silent"), (1, "", "xx", "only"), (1, None, "xx", "other"), (7, "Apple Apple", "en", "big"), (7, "Apple Apple", "en", "big")]
    return rows


def found(df):
    return {tuple(r) for r in df.collect()}


def test_cells_of_any_size_give_the_same_rows(spark):
    rows = rows_for(3)
    docs = spark.createDataFrame(rows, DOCS)
    for group_size, term_size in ((2, 3), (1, 1), (16, 4096)):
        audit = divergence_audit(docs, least_docs=5, most_terms=3, group_size=group_size, term_size=term_size)
        assert audit.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert found(audit) == brute(rows, 5, 3)


def test_other_columns_and_empty_tables(spark):
    rows = rows_for(5, 40)
    docs = spark.createDataFrame(rows, DOCS)
    wide = docs.select("*", *[F.lit("x").alias(c) for c in ("term", "n", "p", "block", "k", "a.b", "item", "value")])
    assert found(divergence_audit(wide, least_docs=2)) == brute(rows, 2, 50)
    assert divergence_audit(docs.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None, None, None), (2, None, None, "s")], DOCS)
    assert found(divergence_audit(nothing)) == {("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)}


def test_counts_above_nine_digits_stay_exact(spark):
    many = 5_000_000_000_000
    counts = spark.createDataFrame(
        [("en", s, w, n, 40) for s, n in (("a", many), ("b", 3)) for w in ("x", "y")] + [("en", "a", None, 0, 0), ("en", "b", None, 0, 0)],
        "lang string, source string, term string, n long, docs long",
    )
    groups, shares = divergence_cube.distributions(counts, 30)
    assert {r["p"] for r in shares.collect()} == {1 + 10**9 * (many + 5) // (2 * many + 10), 1 + 10**9 * 8 // 16}


def test_long_texts_are_split_between_terms(monkeypatch):
    text = ("Ünï wörd-" * 500).encode()
    whole = [w for found in terms_of(text) for w in found]
    monkeypatch.setattr(divergence_cube, "PIECE", 7)
    assert [w for found in terms_of(text) for w in found] == whole
