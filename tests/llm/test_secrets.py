import hashlib
import random
import re

from scriptorium.llm import secrets
from scriptorium.llm.secrets import digest, scan

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text, re.ASCII) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_matches_regular_expressions(make_docs, nasty, tmp_path):
    rng = random.Random(1)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", "'", '"', " ", "  ", ":", "=", "abc", "abcdefgh1", "AKIA", "AKIAABCDEFGHIJKL", "deadbeef" * 5, "é", "🎉", "\n", "Ⓚ", "ſecret", "."]
    texts = nasty + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = {r["doc_id"]: r for r in digest(scan(make_docs(texts), str(tmp_path / "ledger"), path="doc_id")).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i]["spans"] == want, (t, got[i]["spans"], want)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[i]["n_hex"] == want.count("hex:")


def test_ledger_scans_only_what_is_new(spark, make_docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = make_docs(["token = abcdefgh12", "clean", "clean"])
    scan(first, ledger, path="doc_id").collect()
    assert secrets.read_ledger(spark, ledger).count() == 2 * len(secrets.RULES)
    scan(make_docs(["token = abcdefgh12", "new"]), ledger, path="doc_id").collect()
    assert secrets.read_ledger(spark, ledger).count() == 3 * len(secrets.RULES)
    newer = (secrets.Rule("assign", 2, secrets.RULES[0].pattern, 2, 4), *secrets.RULES[1:])
    todo = secrets.pending(first.select(secrets.blob_of(first["text"]).alias("blob")).distinct(), secrets.read_ledger(spark, ledger), newer)
    assert {tuple(r["todo"]) for r in todo.collect()} == {("assign",)}
    rows = scan(make_docs(["token = abcd"]), ledger, path="doc_id", rules=newer).collect()
    assert [f["kind"] for f in rows[0]["findings"]] == ["assign"]


def test_empty_table_and_repeated_paths(make_docs, tmp_path):
    assert scan(make_docs([]), str(tmp_path / "a"), path="doc_id").count() == 0
    rows = digest(scan(make_docs(["token=abcdefgh1"] * 3, [7, 7, None]), str(tmp_path / "b"), path="doc_id")).collect()
    assert len(rows) == 3 and {r["spans"] for r in rows} == {"assign:0:15"}


def test_many_matches_in_one_text(make_docs, tmp_path):
    text = "é " + "\n".join(f"token = abcdefgh{i:06d}" for i in range(100_000))
    (row,) = digest(scan(make_docs([text]), str(tmp_path / "c"), path="doc_id")).collect()
    assert row["n_assign"] == 100_000 and row["spans"] == brute(text)


def test_known_texts_are_not_shuffled(spark, make_docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    scan(make_docs(["known one", "known two", None]), ledger, path="doc_id").collect()
    docs = make_docs(["known one", "known two", "new", "new", ""])
    known = docs.select(secrets.blob_of(docs["text"]).alias("blob"), "text")
    found = secrets.unseen(known, secrets.read_ledger(spark, ledger), secrets.RULES)
    assert [r["text"] for r in found.collect()] == ["new"]
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    text_side = plan[plan.index("first(text") :]
    assert text_side.index("Exchange hashpartitioning(blob") < text_side.index("BroadcastHashJoin")


def test_rows_without_findings(spark, make_docs, tmp_path):
    """Findings of other versions of a rule don't count, and null and empty texts stay."""
    ledger = str(tmp_path / "ledger")
    clean, bad = "nothing to see here", "password = hunter2hunter2"
    blob = lambda t: hashlib.sha256(t.encode()).digest()
    spark.createDataFrame([(bytearray(blob(clean)), "assign", 0, [(0, 4)]), (bytearray(blob(clean)), "gone", 1, [(0, 4)])], secrets.LEDGER).write.parquet(ledger)
    docs = make_docs([clean, bad, None, "", bad, None, clean], [1, 2, 3, None, 2, None, 5])
    found = secrets.scan(docs, ledger, path="doc_id")
    kept = secrets.without_findings(docs, found)
    assert kept.columns == docs.columns and sorted(str(r["text"]) for r in kept.collect()) == sorted([clean, clean, "None", "None", ""])
