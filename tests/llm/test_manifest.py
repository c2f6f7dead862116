"""The Merkle manifest against a direct tree, with nulls, repeated rows, lone leaves and blocks within blocks."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, index int, data int, path int, `_index` int"


def digest(*texts) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, text) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(leaves: list[str], fanout: int) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def proof_of(levels: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        a = i // fanout * fanout
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
        i //= fanout
    return out


def rows() -> list[tuple]:
    out = [(k, f"s{k % 3}" if k % 2 else "hot", "de" if k % 5 else None, k if k % 7 else None, f"line ß {k}\n\nmore" if k % 4 else "flat") for k in range(97)]
    out += [(200, None, None, None, None), (201, None, "", 0, ""), (202, "", "en", 1, "\n"), (203, "ä", "en", 1, "x" * 50000 + "\n"), (None, "hot", "en", 1, "a\nb"), (None, "hot", "en", 1, "a\nb")]
    out += [(5, "s2", "en", 3, "same id"), (4, "hot", None, 4, "line ß 4\n\nmore")] * 2
    return [(*r, "x", 1, 2, 3, 4) for r in out]


@pytest.mark.parametrize(("fanout", "height"), [(3, 1), (3, 2), (3, 7), (2, 2)])
def test_manifest_is_the_direct_tree(spark, fanout, height):
    from docstrata.llm.manifest import document_leaves, folded, merkle_proofs

    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    found = merkle_proofs(document_leaves(docs), "leaf", "source", ["doc_id"], fanout, height)
    found = found.withColumn("back", folded(F.col("leaf"), F.col("proof"))).collect()
    groups: dict = {}
    for r in rows():
        groups.setdefault(r[1], []).append((r[0], leaf_of(r, r[4])))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {k: tree([x[1] for x in g], fanout) for k, g in groups.items()}
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    crown = tree([trees[k][-1][0] for k in names], fanout)
    expected = [(k, *x, trees[k][-1][0], tuple(proof_of(trees[k], i, fanout) + proof_of(crown, names.index(k), fanout))) for k in names for i, x in enumerate(groups[k])]
    got = [(r.source, r.doc_id, r.leaf, r.subroot, tuple((x.left, x.right) for x in r.proof)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert {r.root for r in found} == {crown[-1][0]} == {r.back for r in found}


def test_tampered_texts_fail(spark):
    from docstrata.llm.manifest import verified_manifest

    found = verified_manifest(spark.createDataFrame(rows(), SCHEMA)).collect()
    changed = sorted((r[0], leaf_of(r, r[4])) for r in rows() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or ""))
    assert sorted((r.doc_id, r.leaf) for r in found if not r.verified) == changed and len(found) == len(rows())
    for r in found:
        assert r.proof_sha256 == digest(*(x.left + x.right for x in r.proof)) and r.verified == (r.folded_root == r.root)


def test_empty_and_lone(spark):
    from docstrata.llm.manifest import verified_manifest

    assert verified_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    row = verified_manifest(spark.createDataFrame(rows()[:1], SCHEMA)).head()
    assert row.leaf == row.subroot == row.root and row.proof == [] and row.proof_sha256 == digest() and row.verified
