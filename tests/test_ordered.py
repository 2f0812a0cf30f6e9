"""Records keep their order and number however files are split."""

import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylva.operators import snapshots
from sylva.sources import ordered, records




def by_ranges(data, size, blocks):
    out = []
    for begin in range(0, len(data), size):
        out += ordered.records_of(io.BytesIO(data), begin, min(begin + size, len(data)), blocks)
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "", "", "def é"]), max_size=12), st.sampled_from([b"\n", b"\r\n"]), st.booleans(), st.booleans(), st.integers(1, 9))
def test_any_ranges(lines, end, closed, blocks, size):
    data = end.join(x.encode() for x in lines) + (end if closed else b"")
    want = [(at, text) for at, text in by_ranges(data, max(1, len(data)), blocks)]
    assert by_ranges(data, size, blocks) == want
    expected, held = [], []
    for x in lines:
        if blocks and x and held:
            held.append(x)
        elif x:
            expected.append(held := [x])
        if not x or not blocks:
            held = []
    assert [text for _, text in want] == ["\n".join(x) for x in expected]
    assert all(data[at : at + 1] == text.encode()[:1] for at, text in want)


@pytest.mark.parametrize("crlf", [False, True])
def test_tagged_files(spark, tmp_path, crlf):
    """1, 3 and about 50 ranges, several files, no blank line at the end: the same rows, and the same record wins."""
    rng = random.Random(3)
    blocks = [f"... depotFile //d/{k % 40}\n... clientFile /w/{k % 40}\n... headRev {k}\n... headType text{'+w' if k % 2 else ''}" for k in range(300)]
    for n in range(3):
        text = ("\n" * rng.choice([2, 3])).join(blocks[n * 100 : n * 100 + 100])
        (tmp_path / f"part-{n}.txt").write_bytes((text.replace("\n", "\r\n") if crlf else text).encode())
    (tmp_path / "_SUCCESS").write_bytes(b"no record")
    size = sum(p.stat().st_size for p in tmp_path.iterdir())
    seen = []
    for ranges in (1, 3, 50):
        df = records.parse_tagged_records(spark, str(tmp_path), range_bytes=-(-size // ranges))
        rows = df.orderBy("seq").collect()
        assert [r["head_rev"] for r in rows] == list(range(300))
        seen.append([tuple(r) for r in rows])
        assert {r["head_rev"] for r in snapshots.dedupe_records(df).collect()} == set(range(40))
    assert seen[0] == seen[1] == seen[2]


def test_feeds_and_last_wins(spark, tmp_path):
    lines = [f'{{"code":"stat","depotFile":"//d/{k % 9}","path":"/w/{k % 9}","syncTime":"{k}"}}' for k in range(200)]
    (tmp_path / "feed").write_text("\n".join(lines))
    for range_bytes in (100, 1 << 20):
        assert [r["depotFile"] for r in records.read_preview_feed(spark, str(tmp_path / "feed"), range_bytes).orderBy("seq").collect()] == [f"//d/{k % 9}" for k in range(200)]
    assert {r["path_key"]: r["sync_time"] for r in records.read_have(spark, str(tmp_path / "feed")).collect()} == {f"/w/{k % 9}": max(x for x in range(200) if x % 9 == k % 9) for k in range(9)}
    (tmp_path / "cut").write_text(lines[0] + "\n" + lines[1][:20])
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        records.read_preview_feed(spark, str(tmp_path / "cut")).collect()
    (tmp_path / "none").mkdir()
    assert ordered.ordered_records(spark, str(tmp_path / "none")).agg(F.count("*")).first()[0] == 0
