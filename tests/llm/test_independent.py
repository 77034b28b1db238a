"""op4's base spans and op7's placement against versions written from their definitions alone."""

import hashlib
import re

from lexloom.llm import queries, secrets

SF = "/root/testdata/sf0.001"


def test_base_spans(spark):
    patterns = [
        ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        ("access", re.compile("(AKIA[A-Z0-9]+)"), 1, 20), ("hex", re.compile("([0-9a-f]+)"), 1, 24),
    ]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op4_secret_scan(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        spans = [(m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(patterns) for m in p.finditer(texts[r.doc_id]) if len(m.group(g)) >= least]
        want = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))
        assert hashlib.sha256(want.encode()).hexdigest() == r.base_sha256
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_added_spans():
    """What the lexer adds: literals that only constants, names or concatenation make sensitive."""
    code = "seed = 'Zx81kLmQ9aB0'\nauth_header = seed\n\nclient_secret_value = 'aa' + 'Bb12Cd34Ef'\nsignature := Qm9vS3RyaW5nMTIz\ncolour = 'Zx81kLmQ9aB0x'\n"
    found = [code[a:b] for a, b in secrets.lexed(code)]
    assert "aa" in found and "Bb12Cd34Ef" in found and "Zx81kLmQ9aB0x" not in found
    assert not secrets.base_spans(code) or {s[0] for s in secrets.base_spans(code)} <= {"assign"}


def test_placement(spark):
    """Shards in turn take the first slot of their own walk that is free."""
    slots, names = 65_537, queries.SHARDS

    def walk_of(name):
        digest = hashlib.sha256(name.encode()).hexdigest()
        offset, skip = int(digest[:16], 16) % slots, int(digest[16:32], 16) % (slots - 1) + 1
        for i in range(slots):
            yield (offset + i * skip) % slots

    walks = [walk_of(name) for name in names]
    owner: dict[int, str] = {}
    while len(owner) < slots:
        for name, walk in zip(names, walks):
            if len(owner) == slots:
                break
            owner[next(s for s in walk if s not in owner)] = name
    rows = queries.op7_sharding(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % slots
        assert (r.slot, r.shard) == (slot, owner[slot])
    sizes = [list(owner.values()).count(n) for n in names]
    assert max(sizes) - min(sizes) <= 1
