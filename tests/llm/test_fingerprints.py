"""Fingerprints against brute force over the whole table."""

import hashlib
import unicodedata
from collections import defaultdict

from lodeseam.llm import fingerprints as fp


def canon(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    groups = defaultdict(list)
    for i, t in rows:
        groups[canon(t)].append(i)
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        own = groups[canon(t)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(canon(t) == canon(nxt)), min((x for x in own if x is not None), default=None), len(own)))
    return sorted(out, key=str)


def got(df, **kw):
    rows = fp.fingerprint_edits(df, **kw).collect()
    return rows, sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.group_id, r.copies) for r in rows), key=str)


def test_against_brute_force(docs, rows, empty, spark):
    for bucket_rows in (7, 1000):
        made, table = got(docs, bucket_rows=bucket_rows)
        assert table == brute([(r[0], r[1]) for r in rows])
    by_text = {r[0]: canon(r[1] or "") for r in rows}
    pairs = {(by_text[r.doc_id], r.fingerprint) for r in made}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert fp.fingerprint_edits(empty).count() == 0
    odd = [(None, "null id"), (5, "five"), (5, "again five"), (-3, "minus"), (9, None)]
    assert got(spark.createDataFrame(odd, "doc_id long, text string").repartition(3), bucket_rows=1)[1] == brute(odd)
    assert got(spark.createDataFrame([(1, "alone here")], "doc_id long, text string"))[1] == brute([(1, "alone here")])


def test_canonical_form():
    assert fp.canonical("  Ｓtraße ﬁ\n") == "strasse fi".encode()
    assert fp.fingerprint("A  b") == fp.fingerprint("a B") != fp.fingerprint("ab")


def test_identifiers_of_other_types(spark):
    texts = [f"text number {i % 7} é" for i in range(40)]
    for kind, ids in (("string", [f"k{i:03d}" for i in range(40)]), ("smallint", list(range(40))), ("date", None)):
        df = spark.createDataFrame(list(zip(ids or range(40), texts)), f"doc_id {kind if ids else 'int'}, text string")
        df = df if ids else df.selectExpr("date_add(date'2020-01-01', doc_id) as doc_id", "text")
        assert fp.fingerprint_edits(df, bucket_rows=9).schema["doc_id"].dataType.simpleString() == kind
        got_rows = {r.doc_id: r for r in fp.fingerprint_edits(df, bucket_rows=9).collect()}
        order = sorted(got_rows, reverse=True)
        plain = {r.doc_id: r.text for r in df.collect()}
        for k, i in enumerate(order):
            nxt, t = plain[order[(k + 1) % 40]], plain[i]
            edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
            assert got_rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got_rows[i].copies == texts.count(t)
