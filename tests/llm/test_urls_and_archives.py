import hashlib
import random
import re

import pytest

from focalis.llm import url_filter as U
from focalis.llm import warc as W


def judged(url, rules):
    """By definition, rule by rule."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[:1:-1] if fit else (None, "allow")))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("b.a.org", "/x", "allow"), ("a.org", "/yzx", "block"), ("a.org", "/yzx", "allow")]


def test_urls(spark):
    r = random.Random(2)
    urls = ["http://example.net", "http://example.net/", "HTTP://EXAMPLE.NET/en/1?x=/de/#a", "no scheme", None, "", "://", "http://xnet/", "http://a.org?q", "http://b.a.org/x", "ftp://u@É.net/a://b.com/", "http://a.net\n/x", "http://net/", "http://.net/", "http://a.org/yzx", "http://" + "a." * 4000 + "example.net/" + "en/" * 5000, "http://" + "x" * 100_000 + ".org/fr/", "http://..net./", "http://a..net/"]
    for _ in range(300):
        host = ".".join(r.choice(["a", "b", "example", "org", "net", "com"]) for _ in range(r.randint(1, 4)))
        urls.append(f"http://{host}{r.choice(['', '/', '/en/', '/de/', '/fr/', '/x', '/yzx/'])}{r.choice(['', 'en/', '?a', '#b'])}")
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)] + [(0, urls[0], "old", 1)], "page_id long, url string, host string, _best int")
    for bound in (U.BROADCAST_RULES, 0):
        U.BROADCAST_RULES, kept = bound, U.BROADCAST_RULES
        out = U.judge(pages, U.rule_table(spark, RULES))
        U.BROADCAST_RULES = kept
        rows = out.collect()
        assert len(rows) == len(urls) + 1 and out.columns == ["page_id", "url", "_best", "host", "path", "rule", "verdict"]
        for x in rows:
            assert (x.host, x.path, x.rule, x.verdict) == judged(x.url, RULES), x.url
    assert U.judge(pages.limit(0), U.rule_table(spark, RULES)).count() == 0
    assert {x.verdict for x in U.judge(pages, U.rule_table(spark, RULES).limit(0)).collect()} == {"allow"}


PAGES = [(3, "http://a/?q=é \r\n%41", "<p>" + "same " * 40), (1, None, "<p>" + "same " * 40), (2, "u", "<p>" + "same " * 40), (4, "u", "short"), (5, "v", "short"), (6, "w", None), (7, "", ""), (None, "n", "<p>" + "same " * 40), (8, "long", "é中\r\n\r\nWARC/1.1 \x1f\x8b\x08" * 30_000), (1, "again", "<p>" + "same " * 40), (9, "x", "\x00" * 99), (10, "x", "\x00" * 100), (11, "x", "\x00" * 100)]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first", "3 as text").repartition(3)
    m = W.write_archives(df)
    got = W.read_archives(spark, m, split_bytes=700).collect()
    size = lambda t: len((t or "").encode())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for i, u, t in PAGES:
        first = min((j for j, _, s in PAGES if s == t and j is not None), default=None)
        copy = size(t) >= 100 and sum(s == t for _, _, s in PAGES) > 1 and first is not None and i != first
        want.append((i, u, "revisit" if copy else "response", first if copy else None, size(t), digest(t), None if copy else (t or "").encode()))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.declared_bytes, r.declared_digest, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    empty = W.write_archives(df.limit(0))
    assert empty.count() == 0 and W.read_archives(spark, empty).count() == 0


def test_every_split_reads_every_record_once(tmp_path):
    payloads = [b"x" * n for n in (0, 10, 5000)] + [bytes(random.Random(1).randrange(256) for _ in range(3000)) + W.MAGIC * 5]
    data = b"".join(W.member("response", i, f"u{i}", p, hashlib.sha256(p).hexdigest(), len(p), None) for i, p in enumerate(payloads * 3))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"noise \x1f\x8b\x08 noise" + data + W.MAGIC + b"cut")
    total = path.stat().st_size
    for step in (37, 500, 2500, total):
        found = [W.parse(r)["payload"] for s in range(0, total, step) for r in W.records(f"file://{path}", s, min(s + step, total))]
        assert found == payloads * 3


@pytest.mark.parametrize("n", [1, 2, 3])
def test_magic_across_reads(tmp_path, monkeypatch, n):
    data = W.member("response", 1, "u", b"abc", "d", 3, None)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"-" * (64 - n) + data)
    monkeypatch.setattr(W, "STEP", 64)
    assert len(list(W.records(f"file://{path}", 0, 200))) == 1
