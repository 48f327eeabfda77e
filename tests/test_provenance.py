import hashlib
import struct

import pytest

from modalens.operators import profile, provenance


def sha(*parts):
    return hashlib.sha256("\u0001".join(parts).encode()).hexdigest()


def folded(rows, levels):
    """Digest of (path, hash) rows by buckets of the path's first digits, level by level."""
    for level in range(levels, -1, -1):
        buckets = {}
        for path, h in rows:
            buckets.setdefault(path[: 3 * level], []).append(h)
        rows = [(p, hashlib.sha256(",".join(sorted(hs)).encode()).hexdigest()) for p, hs in buckets.items()]
    return rows[0][1]


@pytest.mark.parametrize("bucket,levels", [(4096, 1), (1, 2)])
def test_digests_of_features(spark, monkeypatch, bucket, levels):
    monkeypatch.setattr(provenance, "BUCKET", bucket)
    values = [0.0, -0.0, 1e-320, 0.1, -2.5e300, float("inf"), None, *[i / 7 for i in range(5000 if bucket == 1 else 20)]]
    rows = [(str(i), "m", "f", v) for i, v in enumerate(values)]
    bits = lambda v: "NA" if v is None else str(struct.unpack(">q", struct.pack(">d", v))[0])
    hashes = [sha(s, m, f, bits(v)) for s, m, f, v in rows]
    schema = "sample_id string, modality string, feature string, value double"
    got = provenance.feature_digests(spark.createDataFrame(rows[::-1], schema).repartition(5)).first()
    assert (got.n, got.digest) == (len(rows), folded([(h, h) for h in hashes], levels))
    moved = [(s, m, f, -0.0 if s == "0" else v) for s, m, f, v in rows]
    assert provenance.feature_digests(spark.createDataFrame(moved, schema)).first().digest != got.digest


def test_fingerprint_of_an_empty_study_and_of_changed_targets(spark):
    cells = spark.createDataFrame([("1", "a", "x", 1.0), ("2", "a", "x", 2.0)], "sample_id string, modality string, feature string, value double")
    samples = spark.createDataFrame([("1", 0), ("2", None)], "sample_id string, y int")
    whole = provenance.fingerprint(cells, samples, "y").first()
    assert (whole.n_cells, whole.n_samples) == (2, 2)
    assert provenance.fingerprint(cells, samples.fillna(1), "y").first().digest != whole.digest
    empty = provenance.fingerprint(cells.limit(0), samples.limit(0), "y").first()
    assert (empty.n_cells, empty.n_samples) == (0, 0) and len(empty.digest) == 64


def test_exclusion_rules(spark):
    """1 and 3 are copies, 2 has a table less, 4 no outcome, 5 no subject and no cells, 6 is alone in its class."""
    cells = [(s, m, "x", v) for s, v in (("1", 1.0), ("3", 1.0), ("4", 2.0), ("6", -0.0)) for m in ("a", "b")] + [("2", "a", "x", 1.0), ("2", "b", "x", None)]
    samples = [("1", "u", "p"), ("2", "u", "q"), ("3", "u", "r"), ("4", None, "s"), ("5", "u", None), ("6", "w", "t")]
    cells = spark.createDataFrame(cells, "sample_id string, modality string, feature string, value double")
    samples = spark.createDataFrame(samples, "sample_id string, label string, group_id string")
    want = {"no outcome": 1, "no subject": 1, "not in every table": 2, "small class": 1, "duplicate rows": 1}
    assert {r.rule: r.n for r in profile.exclusion_rules(cells, samples, "label", min_class=2).collect()} == want
    assert {r.n for r in profile.exclusion_rules(cells.limit(0), samples.limit(0), "label").collect()} == {0}
