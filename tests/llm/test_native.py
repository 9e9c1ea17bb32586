"""Sharding, mixing, personal data and licenses against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodeseam.llm import licenses, mixing, pii, sharding

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def test_pii(docs, rows, empty):
    texts = {r[0]: r[1] or "" for r in rows}
    got = pii.digest(pii.find_pii(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = base_spans(texts[r.doc_id])
        listed = [f"{k}:{s}:{e}" for s, _, k, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), texts[r.doc_id][:80]
        n = Counter(k for _, _, k, _ in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [n[k] for k in BASE]
        assert [x for x in r.spans.split(",") if x and not x.startswith("iban")] == listed
    assert [r.spans.count("iban") for r in got if r.doc_id == 14] == [2]
    assert pii.digest(pii.find_pii(empty)).count() == 0


def test_pii_context_raises_the_score_and_masks(spark):
    df = pii.find_pii(spark.createDataFrame([(1, "my card 4111111111111111 ok"), (2, "xx 4111111111111111 yy"), (3, None)], "doc_id long, text string"))
    got = {r.doc_id: r for r in df.select("doc_id", "_pii", pii.masked(df["text"], df["_pii"]).alias("m")).collect()}
    assert got[1]._pii[0].score > got[2]._pii[0].score
    assert got[1].m == "my card <CARD> ok" and got[3].m is None


def test_accounts_before_capitals(spark):
    de, spaced, gb = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    texts = [
        f"{de} BIC COBADEFF", f"pay {de} EUR 5", f"{gb} I said", f"{spaced} BIC COBADEFFXXX", f"{gb} {de} {spaced}", f"AB12 {spaced} X", f"\U0001f600 {spaced} EUR and {gb}", f"{de}BIC COBADEFF",
        "DE89370400440532013001 BIC COBADEFF", f"x{de}", f"{de}abc", "NO9386011117947 5 EUR", f"{de}.",
    ]
    want = [[de], [de], [gb], [spaced], [gb, de, spaced], [spaced], [spaced, gb], [], [], [], [], ["NO9386011117947"], [de]]
    df = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r for r in df.select("doc_id", "_pii", pii.masked(df["text"], df["_pii"]).alias("m")).collect()}
    for i, (t, w) in enumerate(zip(texts, want, strict=True)):
        assert [t[x.start : x.end] for x in got[i]._pii if x.kind == "iban"] == w, t
    assert got[3].m == "<IBAN> BIC COBADEFFXXX" and got[4].m == "<IBAN> <IBAN> <IBAN>"


def places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return words, found


def contained(text):
    out = []
    for block in re.split(licenses.BLOCKS, text):
        words = set(places(block)[0])
        for t, label in licenses.TEMPLATES.items():
            own = set(t.split())
            if 10 * len(own & words) >= 8 * len(own):
                out.append((label, len(own & words) / len(own)))
    return out


def test_licenses(docs, rows, empty):
    texts = {r[0]: r[1] or "" for r in rows}
    got = licenses.digest(licenses.scan_licenses(licenses.phrase_places(docs))).collect()
    assert len(got) == len(rows)
    for r in got:
        words, found = places(texts[r.doc_id])
        own = contained(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert r.labels == ",".join(sorted({x for _, x in found} | {x for x, _ in own})), texts[r.doc_id][:60]
        assert r.score == pytest.approx(max([0.0, *(c for _, c in own)]))
    assert licenses.digest(licenses.scan_licenses(licenses.phrase_places(empty))).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, containment=0)


def test_wrapped_licenses(spark):
    texts = {
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "gpl-text": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published",
        "mpl-2.0": "# This Source Code Form is subject to the terms of the Mozilla Public\r\n# License, v. 2.0. If a copy",
        "apache-2.0": " * Licensed\n * under the\n * Apache License,\n * Version 2.0",
        "mit-notice": "Released under the\nMIT License",
        "": "Redistribution and use in source and binary forms.\n\nWith or without modification, are permitted",
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r.doc_id: r._licenses for r in licenses.scan_licenses(df).collect()}
    assert [sorted({x.label for x in got[i]}) for i in range(len(texts))] == [[t] if t else [] for t in texts]


def test_sharding(docs, rows, empty, tmp_path):
    got = sharding.assign_shards(docs, shards=5, bucket_rows=4).collect()
    again = sharding.assign_shards(docs.repartition(7), shards=5, bucket_rows=4).collect()
    assert sorted(got) == sorted(again)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    grown = {r.doc_id: r.shard for r in sharding.assign_shards(docs, shards=6, bucket_rows=4).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    assert sharding.assign_shards(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, shards=0)
    back = sharding.write_shards(docs, str(tmp_path / "s"), shards=5)
    assert sorted(map(str, (r[:7] for r in back.select(*docs.columns).collect()))) == sorted(map(str, rows))


def test_sharding_moves_whole_records(spark, docs, rows, tmp_path):
    for bucket_rows in (4, 64):
        path = str(tmp_path / f"s{bucket_rows}")
        got = sharding.assign_shards(docs, shards=3, bucket_rows=bucket_rows, path=path).collect()
        back = spark.read.parquet(path).collect()
        assert sorted(map(str, (r[:7] for r in back))) == sorted(map(str, rows))
        data = lambda t: (t or "").encode()
        assert sorted((r._shard, r._slot, r.doc_id, len(data(r.text)) + 8, zlib.crc32(data(r.text))) for r in back) == sorted((r.shard, r.slot, r.doc_id, r.size, r.text_crc32) for r in got)
    ones = spark.createDataFrame([(None, "a")] * 5 + [(None, None), (7, "b"), (7, "c")], "doc_id long, text string")
    got = sharding.assign_shards(ones, shards=2, bucket_rows=2).collect()
    assert Counter(r.size for r in got) == {9: 7, 8: 1} and len({(r.shard, r.slot) for r in got}) == 8


def filled(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    target, open_ = {}, set(names)
    left = sum(sizes.values())
    while open_:
        share = {n: left * weight[n] / sum(weight[x] for x in open_) for n in open_}
        over = {n for n in open_ if share[n] > 3 * sizes[n]}
        if not over:
            return target | share
        for n in over:
            target[n] = 3 * sizes[n]
            left -= target[n]
        open_ -= over
    return target


def test_mixing(docs, rows, empty):
    got = mixing.mix_sources(docs, range_rows=6).collect()
    source = {r[0]: r[3] for r in rows}
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(mixing.WORD, r[1] or ""))
    target = filled(size)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        assert len(r.positions) == (-(-r.taken // r.size) if r.size else 0) and r.positions == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        assert not r.positions or r.positions[0] == r.position
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5), range_rows=6).collect()))
    where = [r.position for r in got if r.position is not None]
    assert where == sorted(where) and 0 <= min(where) <= max(where) <= 1
    assert mixing.mix_sources(empty).count() == 0


def test_training_time_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        df = spark.range(0, 101).select((F.col("id") / 100).alias("u")).select("u", mixing.training_time(F.col("u"), knots).alias("t"))
        whole = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))
        for r in df.collect():
            area = 0.0
            for (t0, a), (t1, b) in zip(knots, knots[1:]):
                end = min(max(r.t, t0), t1)
                area += (end - t0) * (a + a + (b - a) * (end - t0) / (t1 - t0)) / 2
            assert area / whole == pytest.approx(r.u, abs=1e-9)
