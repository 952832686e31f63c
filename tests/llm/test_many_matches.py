"""Personal data in texts with very many matches, and the base kinds against brute force and SQL."""

import hashlib
import re
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from voltmill.llm import pii
from voltmill.llm.oracles import OP10_BASE
from voltmill.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def brute(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if passes(k, m.group())]


def test_base_kinds(spark):
    r = np.random.default_rng(6)
    card = lambda: "4111 1111 1111 1111" if r.random() < 0.5 else "".join(r.choice(list("0123456789- "), 24))
    phone = lambda: "+" + "".join(r.choice(list("0123456789 ().-"), int(r.integers(3, 20))))
    words = lambda: "".join(r.choice(list("ab.@é1 "), 12))
    texts = [" ".join(f() for f in r.choice([card, phone, words], 30)) for _ in range(40)] + ["", None, "1.2.3.4.5.6.7.8", "+1 (234) 567-8901 x +1", "a@b.c" * 600]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()
    assert any(s.kind == "card" for x in found for s in x.spans) and any(s.kind == "phone" for x in found for s in x.spans)
    for x in found:
        assert [(s.kind, s.start, s.end) for s in x.spans if s.kind in PATTERNS] == brute(texts[x.i]), texts[x.i]


def test_fifty_thousand_matches_in_one_text(spark):
    n = 50_000
    text = " é ".join(f"user{i}@mail.example.com" for i in range(n))
    docs = spark.createDataFrame([(text,)], "text string")
    began = time.time()
    spans = pii.find_pii(docs).first().spans
    assert [(s.kind, s.start, s.end) for s in spans] == brute(text) and len(spans) == n
    assert pii.redact(docs).first().text == " é ".join(["[EMAIL]"] * n)
    assert time.time() - began < 90


def test_context_reaches_past_neighbours(spark):
    near, far = "ssn 123-45-6789 234-56-7890", "ssn 123-45-6789 " + "x" * 60 + " 234-56-7890"
    got = pii.find_pii(spark.createDataFrame([(0, near), (1, far), (2, "234-56-7890 345-67-8901 is my ssn")], "i long, text string")).orderBy("i").collect()
    assert [[(s.start, s.score) for s in x.spans] for x in got] == [[(4, 0.6), (16, 0.6)], [(4, 0.6)], [(0, 0.6), (12, 0.6)]]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:6] for r in con.sql(f"SELECT doc_id, n_email, n_ip, n_card, n_phone, base_sha256 FROM ({OP10_BASE})").fetchall()}
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in QUERIES["op10_pii"](spark, sf).collect()}
    assert got == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") % 3 == 0).collect()}
    for i, t in texts.items():
        assert got[i][4] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest()
