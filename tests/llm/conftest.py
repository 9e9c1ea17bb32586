"""Documents that hold every case the operators must define: nulls, empties, ties, copies, long texts."""

import pytest

TEXTS = [
    None, "", " ", "\n\t", "a", "one two three four five six seven", "one two three four five six seven", "ONE two three four five  six seven",
    "Straße ﬁne café", "strasse fine café", "mail: a.b+c@x-y.example.com, bob@c.d_e@f.gh and x@y",
    "host 10.0.0.255 and 1.2.3.4.5.6.7.8 but 256.1.1.1 or 01.2.3.0004", "card 4111 1111 1111 1111, 4111-1111-1111-1112; 5500005555555559 1-2--3",
    "call +1 (499) 555-6503 now +49 30 1234567 +1 2 ++44 20 7946 0958.", "IBAN GB82WEST12345698765432 or DE89 3704 0044 0532 0130 00, GB82WEST12345698765431",
    "Released under the MIT License.\nMIT license, mit-license", "Licensed under the Apache License, Version 2.0.", "licensed UNDER the apache",
    "This work is licensed under the GNU General Public License, version 3. General public license", "Licensed under CC BY-NC 4.0.",
    "KKelvin mit license x mıt lıcense İ", "😀 a@b.co 😀 8.8.8.8 😀", "1" * 5000, "a@" * 3000, "é" * 4000, "word " * 9000, "x\u0001y\u001ez $1 \\1 (a)",
]


@pytest.fixture(scope="session")
def rows():
    out = [(i, t, "en", ["s1", "s2", None, "s0"][i % 4], len(t or ""), "clash", 1.5) for i, t in enumerate(TEXTS)]
    out += [(100 + i, TEXTS[5], "en", "hot", 10, "clash", 2.5) for i in range(40)]
    out += [(200, "same row twice", "en", "s1", 14, "clash", 0.0)] * 3
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, target double").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
