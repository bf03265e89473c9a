"""Product codes against plain comparison with every entry, and their defined cases."""

from __future__ import annotations

import hashlib

import numpy as np

from flowsift.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code long, place string"


def _plain(rows: list[tuple], parts: int, entries: int, rounds: int) -> dict:
    rows = sorted(rows, key=lambda r: r[0])
    x = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for last in [False] * rounds + [True]:
        apart = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        code = apart.argmin(axis=2)
        if not last:
            for p in range(parts):
                for e in set(code[:, p].tolist()):
                    books[p, e] = x[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()
    error = apart.min(axis=2).sum(axis=1)
    label = {b: sum(int(e) for e, r in zip(error, rows) if r[2] == b) for b in {r[2] for r in rows}}
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return {r[0]: ("".join(f"{c:02x}" for c in code[i]), int(error[i]), label[r[2]], digest) for i, r in enumerate(rows)}


def _got(df) -> dict:
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()}


def test_codes_against_plain(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(7, 24))
    rows = [(int(i), (centres[i % 7] + rng.normal(scale=0.2, size=24)).astype(np.float32).tolist(), None if i % 3 == 0 else int(i % 4), "v", 1, "p") for i in rng.permutation(900)]
    got = _got(vector_codes.encode(spark.createDataFrame(rows, SCHEMA).repartition(5), parts=6, entries=20, rounds=2))
    assert got == _plain(rows, 6, 20, 2)


def test_annulus_sees_ties_and_all_norms():
    rng = np.random.default_rng(4)
    entries, rows = rng.integers(-9, 9, (40, 3)), rng.integers(-12, 12, (3000, 3))
    entries[30:] = entries[:10]  # repeated entries: the lowest index counts
    index, best = vector_codes.Codebook(entries).nearest(rows)
    apart = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_odd_vectors(spark):
    good = [0.5, -0.25, 1.0, -1.0]
    rows = [(5, good, None), (1, None, 1), (2, [], 1), (3, [0.5, None, 1.0, 1.0], 1), (4, [0.5, float("nan"), 1.0, 1.0], 1), (6, [0.5, float("-inf"), 1.0, 1.0], 1), (7, [1.0, 2.0], 1), (None, good, 2), (8, good, None), (8, good, None), (9, [1e30, 0.0, -1e30, 0.0], 2)]
    rows = [(*r, "v", 1, "p") for r in rows]
    got = vector_codes.encode(spark.createDataFrame(rows, SCHEMA), parts=2, entries=3, rounds=0).collect()
    assert sorted((r["vec_id"] or -1, r["code"]) for r in got) == [(-1, "0000"), (5, "0000"), (8, "0000"), (8, "0000"), (9, got[[r["vec_id"] for r in got].index(9)]["code"])]
    assert {r["label_error"] for r in got if r["vec_id"] in (5, 8)} == {0}
    assert vector_codes.encode(spark.createDataFrame([], SCHEMA)).collect() == []
    one = vector_codes.encode(spark.createDataFrame([(1, good, None, "v", 1, "p")] * 2, SCHEMA), parts=4).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00000000", 0, 0)] * 2
