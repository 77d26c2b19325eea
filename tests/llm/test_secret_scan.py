"""Secret scans against re, and the ledger's increments."""

import hashlib
import random
import re
from dataclasses import replace

from inkflow.llm.secret_scan import BASE_RULES, FINDINGS, RULES, Ledger, scan_documents

SCHEMA = "doc_id long, text string, sha string, kind int"
PARTS = ["password", "PassWord", "token", "api_key", "APIKEY", "secret", "=", ": ", " = ", "'", '"', "abcdefgh", "A1b2", "tok", " ", "\n", "AKIA", "AKIAABCDEFGHIJKL", "Z" * 13, "0123456789abcdef", "deadbeef" * 4, "é", "🙂", "ſecret", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18]


def brute(text, rules):
    found = []
    for rank, rule in enumerate(rules):
        pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "(?ai:password|passwd|secret|token|api_?key)")
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), rank, rule.kind, m.end()))
    return sorted(found)


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def test_against_re(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 14)))) for i in range(400)]
    rows += [(500, None), (501, ""), (3, rows[3][1]), (502, rows[3][1]), (None, "token=token:abcdefghij secret=longenough"), (503, ("x" * 999 + "password=abcdefgh1 ") * 300)]
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], SCHEMA).repartition(3)
    got = scan_documents(docs, f"file://{tmp_path}/ledger").collect()
    want = []
    for d, t in rows:
        base, full = brute(t or "", BASE_RULES), brute(t or "", RULES)
        n = [sum(k == kind for _, _, kind, _ in base) for k in ("assign", "access", "hex")]
        want.append((d, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(full)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(w[1] for w in want) and any(w[2] for w in want) and any(w[3] for w in want)


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    one = spark.createDataFrame([(1, "password=aaaaaaaa", "", 0), (2, "plain", "", 0)], SCHEMA)
    ledger.scan(one, RULES)
    assert ledger.scanned().count() == 2 * len(RULES)
    two = one.union(spark.createDataFrame([(3, "token: bbbbbbbb9", "", 0), (4, "plain", "", 0)], SCHEMA))
    unseen = ledger.unseen(two.selectExpr("doc_id", "sha2(text, 256) AS sha"), RULES).collect()
    assert [r.doc_id for r in unseen] == [3]
    newer = (replace(RULES[0], version=2, least=9), *RULES[1:])
    assert {tuple(r.kinds) for r in ledger.unseen(one.selectExpr("doc_id", "sha2(text, 256) AS sha"), newer).collect()} == {("assign",)}
    got = {r.doc_id: r.n_assign for r in scan_documents(two, ledger.folder, newer).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}
    assert {r.doc_id: r.n_assign for r in scan_documents(two, ledger.folder, RULES).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_searched_patterns_keep_the_same_matches():
    rng = random.Random(9)
    for rule in (replace(BASE_RULES[1], least=7), replace(BASE_RULES[2], least=5)):
        for _ in range(4000):
            text = "".join(rng.choices(["AKIA", "A", "K", "0", "a", "f", "9", " ", "é"], k=rng.randint(0, 24)))
            kept = [m.span() for m in re.finditer(rule.pattern, text) if len(m[0]) >= rule.least]
            assert [m.span() for m in re.finditer(rule.searched, text)] == kept
    assert BASE_RULES[0].hint.endswith("{8,})") and BASE_RULES[0].searched == BASE_RULES[0].pattern


def test_a_second_scan_moves_no_text(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    docs = spark.createDataFrame([(i, f"password=abcdefgh{i % 30}", "", 0) for i in range(90)], SCHEMA)
    assert len(scan_documents(docs, ledger.folder).where("n_assign = 1").collect()) == 90
    assert ledger.findings(RULES).count() == 30
    assert ledger.unseen(docs.selectExpr("doc_id", "sha2(text, 256) AS sha"), RULES).isEmpty()
    assert len(scan_documents(docs, ledger.folder).where("n_assign = 1").collect()) == 90
    assert ledger._table("findings", FINDINGS).count() == 30


def test_empty_table(spark, tmp_path):
    assert scan_documents(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/l").collect() == []
