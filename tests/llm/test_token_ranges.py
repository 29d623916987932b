"""Raw token files read by byte ranges."""

import numpy as np

from cadenza.llm import tokencounts


def counted(spark, path, **settings):
    found = tokencounts.separator_scan(tokencounts.read_token_files(spark, str(path), **settings))
    return [(r["ordinal"], r["n_tokens"]) for r in found.orderBy("file", "ordinal").collect()]


def test_ranges_of_every_size_give_the_same_counts(spark, tmp_path):
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 30, 40)
    flat = np.concatenate([np.append(rng.integers(0, 50_000, n), tokencounts.SEPARATOR) for n in sizes]).astype("<u2")
    (tmp_path / "some tokens.bin").write_bytes(flat.tobytes())
    wanted = list(enumerate(sizes.tolist()))
    for block, ranges in ((1, 1), (3, 2), (7, 5), (1000, 64)):
        assert counted(spark, tmp_path, block_tokens=block, range_blocks=ranges) == wanted


def test_empty_file_has_no_documents(spark, tmp_path):
    (tmp_path / "none.bin").write_bytes(b"")
    assert counted(spark, tmp_path) == []


def test_a_file_over_two_gigabytes_is_counted(spark, tmp_path):
    at = [5, 70_000, 1 << 30, (1 << 30) + 1, (1 << 30) + 50_000_000]
    with (tmp_path / "sparse.bin").open("wb") as f:
        for p in at:
            f.seek(2 * p)
            f.write(np.array([tokencounts.SEPARATOR], "<u2").tobytes())
    assert (tmp_path / "sparse.bin").stat().st_size > 1 << 31
    gaps = [b - a - 1 for a, b in zip([-1, *at], at)]
    assert counted(spark, tmp_path) == list(enumerate(gaps))
