import hashlib
import random
import re

from pyspark.sql import functions as F

from strandline.llm import pii, queries

from .odd import no_docs, odd_docs


def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    """Base spans as the contract states them."""
    out = []
    for no, (kind, p) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


CASES = [
    "a@b.c_d@e.f", "a@b.c@d.e.f x.y@z", "..@a.b", "a@-.-", "x@y..z", "mail joe.doe+1@ex-ample.co.uk, ok", "é.a@b.cc 😀 b@c.dd",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "0001.002.3.4", "999999999999.1.1.1", "1.2.3", "01.2.3.4.", "192.168.0.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111 1111 1111", "card 4111111111111111 1", "-4111 1111 1111 1111-", "0" * 40, "00000000000000",
    "+1 (017) 555-7713 x", "+1", "+12", "+1 2", "++1 555 123 4567", "+1 555 123 4567 ....", "+1 555 123 4567+44 20 7946 0958", "+1" + " " * 3000, "+1234567890123456",
]


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_spans(docs)
    s = F.col("pii_spans")
    return [r[0] for r in found.select(pii.joined(F.filter(s, lambda x: x["no"] < 4)).alias("x"), "doc_id").orderBy("doc_id").collect()]


def test_base_spans_equal_the_plain_patterns(spark):
    r = random.Random(1)
    texts = CASES + ["".join(r.choice("ab1290 .-@+()_%é😀") for _ in range(r.randrange(60))) for _ in range(1500)]
    texts += ["".join(r.choice(["1.2.3", ".4", "@", "a", "b.c", "+1 555", " 4111 1111", "-", "0042 ", "é"]) for _ in range(r.randrange(12))) for _ in range(1500)]
    assert run(spark, texts) == [brute(t) for t in texts]


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "1." * 20_000, "+1" * 100_000, "a@" * 100_000, "+1" + "-" * 200_000]
    assert run(spark, texts) == ["", "", "", ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(5000)), "", "", ""]


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "IBAN GB82 WEST 1234 5698 7654 33.", "ssn: 123-45-6789", "part 123-45-6789", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "sha1 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [sorted(x.kind for x in r.pii_spans) for r in pii.find_spans(docs).orderBy("doc_id").collect()]
    assert got == [["iban"], [], ["ssn"], [], ["secret"], []]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "write to é@a.b or bob@a.bc now +1 (017) 555-7713."), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(pii.find_spans(docs)).collect()}
    assert got == {1: "write to é@a.b or [EMAIL] now [PHONE].", 2: None, 3: "clean"}


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("pii_body", F.lit(1)).withColumn("PII_email", F.lit(2))
    rows = pii.find_spans(docs).collect()
    assert len(rows) == 8 and all(r.pii_spans == [] for r in rows) and rows[0].pii_body == 1
    assert pii.find_spans(no_docs(spark)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op10_pii(spark, sf_dir).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(k, want)) for k in pii.BASE]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op10_pii(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_words_on_both_sides_and_the_sql(spark, tmp_path):
    """Words after a span count, underscores part words, some numbers are never issued; the SQL says the same."""
    import duckdb

    hexes = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [
        "123-45-6789 is my SSN", "000-45-6789 is my SSN", "ssn 900-45-6789, ssn 123-00-6789, ssn 123-45-0000", f"my_token={hexes}", f"api_key_{hexes}", f"{hexes} md5",
        f"token {hexes} {hexes}", f"{hexes}_{hexes} secret", "GB82WEST12345698765432_iban", "xGB82WEST12345698765432", "ssn 1123-45-6789 a123-45-6789 ssn_123-45-6789_x", None, "", "a@b.cc 1.2.3.4",
    ]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = c.execute(queries.ORACLE_SQL["op10_pii"])
    names = [d[0] for d in cursor.description]
    want = {r[names.index("doc_id")]: r[names.index("spans")] for r in cursor.fetchall()}
    assert got == want
    kinds = {i: [x.split(":")[0] for x in s.split(",") if x] for i, s in got.items()}
    assert [kinds[i] for i in range(len(texts))] == [["ssn"], [], [], ["secret"], ["secret"], [], ["secret"], ["secret"], ["iban"], [], ["ssn"], [], [], ["email", "ip"]]
