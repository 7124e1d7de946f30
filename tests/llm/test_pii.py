import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracekit.llm import pii, secrets

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")),
            "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    out = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def texts():
    rng = random.Random(2)
    alphabet = "a.@-+ 0123456789()_é𝔸\n"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(400)]
    out += [None, "", "a@b.c_d@e.f x.@y.z @@ a@b", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0255 00001.1.1.1", "é𝔸 4111 1111 1111 1111, 4111-1111-1111-1112 4041894974608795",
            "+1 (988) 555-2485 +12 +1 2 3 4 5 6 7 8 9 +123456789012345678", "x" * 20_000 + "@" + "y" * 20_000, "9" * 20_000, "1 " * 5000,
            " ".join(f"u{i}@mail{i}.example.com" for i in range(3000))]
    return out


def test_base_spans_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(7, "again a@b.cd"), (None, "a@b.cd")]
    rows += [(10_000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    found = pii.find_personal_data(df)
    got = [(r.doc_id, r.spans) for r in found.collect()]
    assert len(got) == len(rows)
    base = sorted((str(d), [tuple(s) for s in x if s.kind in pii.BASE]) for d, x in got)
    assert base == sorted((str(d), brute(t)) for d, t in rows)
    for d, x in got:
        own = [(s.start, s.end) for s in x if s.kind in pii.BASE]
        for s in x:
            assert s.kind in pii.BASE or all(e <= s.start or s.end <= b for b, e in own)
    said = {r.doc_id: r for r in found.select("doc_id", *secrets.span_digest("spans", pii.BASE)).collect()}
    some = 10_000 + 5
    want = ",".join(":".join(map(str, s)) for s in brute(dict(rows)[some]))
    assert said[some].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pii.find_candidates(df)._jdf.queryExecution().toString() + pii.find_personal_data(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sum(spark, n):
    df = spark.createDataFrame([([i * i for i in range(n)],)], "a array<long>").select(pii.running_sum(F.col("a")).alias("s"))
    sums, total = [], 0
    for i in range(n):
        total += i * i
        sums.append(total)
    assert df.first().s == sums


def test_estimate_recovers_planted_reliabilities():
    rng = random.Random(11)
    accuracy, counts, truth = [0.95, 0.8, 0.7, 0.9], {}, {}
    for _ in range(20_000):
        t = rng.random() < 0.3
        votes = "".join("-" if rng.random() < 0.2 else "yn"[(rng.random() < a) != t] for a in accuracy)
        counts["k", votes] = counts.get(("k", votes), 0) + 1
        truth.setdefault(votes, []).append(t)
    prob, rates = pii.estimate(counts)
    for a, r in zip(accuracy, rates):
        assert abs(r["t"]["y"] / (r["t"]["y"] + r["t"]["n"]) - a) < 0.05
        assert abs(r["f"]["n"] / (r["f"]["y"] + r["f"]["n"]) - a) < 0.05
    for (k, votes), p in prob.items():
        if counts[k, votes] > 300:
            assert abs(p - sum(truth[votes]) / len(truth[votes])) < 0.1
    assert pii.estimate({}) == ({}, [])


def test_classifier_adds_likely_spans_only(spark):
    rng = random.Random(4)
    rows = [(i, f"please call {rng.randrange(200, 900)}-{rng.randrange(200, 900)}-{rng.randrange(1000, 9999)} today") for i in range(300)]
    rows += [(1000 + i, f"tel: ({rng.randrange(200, 900)}) {rng.randrange(200, 900)}-{rng.randrange(1000, 9999)}, ssn {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}.") for i in range(300)]
    rows += [(2000 + i, f"part #000-00-0000/ of order =111-111-1111{i}") for i in range(300)]
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] == ["local"] for i in range(300)) > 290
    assert sum(found[1000 + i] == ["local", "ssn"] for i in range(300)) > 290
    assert sum(bool(set(found[2000 + i]) - set(pii.BASE)) for i in range(300)) < 10
