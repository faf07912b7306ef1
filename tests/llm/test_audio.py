import numpy as np
import pytest

from focalis.llm import audio as A


@pytest.fixture(scope="module")
def sounds():
    r = np.random.default_rng(0)
    return [A.tones(r.normal(0, 0.2, 64).tolist())[0] for _ in range(40)]


def brute(a, b):
    """The best alignment over all offsets at which integers enough are shared: (shared, error, offset, frames), or None."""
    found = []
    for offset in range(-len(b), len(a) + 1):
        x, y = A.overlap(a, b, offset)
        if len(x) and len(x) >= min(A.MIN_OVERLAP, len(a), len(b)):
            shared, error = int((x == y).sum()), A.bit_errors(x, y)
            if shared >= min(A.MIN_SHARED, len(a), len(b)) and error <= A.MAX_ERROR:
                found.append((-shared, error, offset, len(x)))
    return min(found, default=None)


def table(spark, prints):
    return spark.createDataFrame([(i, p.astype("<u4").tobytes()) for i, p in prints.items()], "id long, print binary")


def test_search_equals_all_offsets(spark, sounds):
    """Noisy and shifted copies, parts, steady tones, long and very short recordings, against all recordings at all offsets."""
    r = np.random.default_rng(1)
    prints = {i + 1: A.fingerprint(s) for i, s in enumerate(sounds)}
    for i in range(0, 40, 2):
        shift = int(r.integers(0, 14)) * A.HOP
        prints[100 * (i + 1)] = A.fingerprint(np.concatenate((r.normal(0, 400, shift), sounds[i] + r.normal(0, 400, len(sounds[i])))))
    tone = np.full(60, 7, np.uint32)
    long = np.concatenate([A.fingerprint(s) for s in sounds] * 3)
    prints |= {10_100: prints[1][:20], 10_200: prints[2][5:6], 10_300: tone, 51: np.concatenate((tone[:9], prints[3])), 10_400: np.concatenate((prints[3], tone[:30])), 52: tone[:3], 10_500: long, 10_600: prints[1], 53: np.zeros(0, np.uint32)}
    got = {}
    for x in A.search(table(spark, prints)).collect():
        if x.match_class is not None:
            got[x.id, x.match_class] = (x.bit_error, x.offset, x.frames)
    classes = {}
    for i, p in sorted(prints.items()):
        classes.setdefault(p.tobytes(), i)
    want = {}
    for i, p in prints.items():
        for j in set(classes.values()):
            if i % 100 == 0 and len(p) and len(prints[j]) and (best := brute(p, prints[j])):
                want[i, j] = best[1:]
    assert got == want and {(10_100, 1), (10_300, 52), (10_600, 1), (10_400, 3), (10_500, 5)} <= set(want)
    near = [i for i in range(0, 40, 2) if (100 * (i + 1), i + 1) in want]
    assert len(near) >= 18


def test_one_integer_of_all(spark):
    """An integer that every recording has makes no matches of its own."""
    r = np.random.default_rng(5)
    prints = {i: np.concatenate((r.integers(0, 2**32, 40, dtype=np.uint32), np.array([99], np.uint32), r.integers(0, 2**32, 40, dtype=np.uint32))) for i in range(0, 400, 2)}
    rows = A.search(table(spark, prints)).collect()
    assert {(x.id, x.match_class) for x in rows if x.match_class is not None} == {(i, i) for i in (0, 100, 200, 300)} and len(rows) == 200


def test_wav(sounds):
    x, rate = A.read_wav(A.write_wav(sounds[0]))
    assert rate == A.RATE and abs(x - sounds[0]).max() <= 1
    assert A.read_wav(None) is None and A.read_wav(b"RIFFxxxxWAVE") is None and A.read_wav(b"junk") is None


def test_tables(spark, sounds):
    silence, short = A.write_wav(np.zeros(40_000)), A.write_wav(sounds[1][:500])
    rows = [(100, A.write_wav(sounds[0])), (3, A.write_wav(sounds[0])), (5, A.write_wav(sounds[2])), (200, A.write_wav(sounds[3])), (7, None), (8, b"junk"), (300, silence), (9, short), (None, A.write_wav(sounds[0])), (3, A.write_wav(sounds[0]))]
    df = spark.createDataFrame(rows, "rec long, sound binary").selectExpr("*", "1 as name", "2 as print", "3 as id")
    got = A.search(A.fingerprints(df, "rec", "sound")).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert [r.class_id for r in got if r.id in (100, 3, None)] == [3] * 4
    assert (by[100].match_class, by[100].offset, by[100].bit_error) == (3, 0, 0.0) and by[200].match_class == 200
    assert by[300].is_query and by[300].match_class is None and by[7].class_id == 7 and not by[5].is_query and by[5].match_class is None
    assert A.search(A.fingerprints(df.limit(0), "rec", "sound")).count() == 0
