import re

import duckdb

from quire.llm import licenses

from .fixtures import documents, prose

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base(text):
    """Words, places of base phrases and their labels, by definition."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


ROWS = [
    (1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "mit license MIT-LICENSE mit  license"),
    (4, "This work is licensed under the GNU General Public License, version 3."), (5, "mit mit LICENSE license cc cc by by"), (6, None), (7, ""),
    (8, "Licensed under CC BY-NC 4.0."), (9, "MİT license, Émit license, mit licenseé"), (10, prose(1, 20_000) + " Apache\nLicense"), (11, "license"), (1, "cc by"),
    (12, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (13, "apache license " * 3000), (None, "cc by"),
    (14, "gnu general public license version"), (15, "\x00cc\x7fby"),
]


def test_base_places(spark):
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(documents(spark, ROWS)).collect()), key=repr)
    assert found == sorted([(i, *base(t)) for i, t in ROWS], key=repr)
    assert licenses.scan(documents(spark, ROWS).limit(0)).count() == 0


def test_notices(spark):
    found = {r.doc_id: (r.labels, r.score) for r in licenses.scan(documents(spark, ROWS[1:])).collect()}
    assert found[2] == ("apache,apache-2.0", 1.0)
    assert found[4] == ("gpl,gpl-3.0", 1.0)
    assert found[8] == ("cc-by,cc-by-nc-4.0", 1.0)
    assert found[12] == ("mit-text", 1.0)
    assert found[11] == found[6] == ("", 0.0)
    assert found[14][0] == "gpl" and 0 < found[14][1] < licenses.SHARE


def test_twin_on_the_same_rows(spark):
    docs = documents(spark, ROWS[1:-1]).filter("doc_id <> 1 AND doc_id IS NOT NULL")
    twin = duckdb.connect()
    twin.register("documents", docs.select("doc_id", "text").toPandas())
    found = sorted((tuple(r) for r in licenses.scan(docs).drop("places").collect()), key=repr)
    assert found == sorted(twin.execute(licenses.twin()).fetchall(), key=repr)
