import random
import time

from pyspark.sql import functions as F

from panelforge.llm import urls as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
    stop = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return host, rest[:stop]


def plain(url, entries):
    """host, path, rule, verdict: every entry is tried."""
    host, path = parts(url)
    best = max(((len(h) + len(p), v, h + p) for h, p, v in entries if h and (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def pages():
    rng = random.Random(2)
    out = [None, "", "no scheme.com/en/", "http://", "://com/en/x", "http://COM/en/1", "https://a.Example.com/en/77?q=/en/", "ftp://x://y.org/es/", "http://com./en/", "http://example.com:80/en/7", "http://net#/de/", "x" * 50_000, "http://" + "a" * 50_000 + ".com/en/" + "b" * 50_000]
    for _ in range(300):
        host = ".".join(rng.choice(["a", "example", "com", "net", "org", "", "É"]) for _ in range(rng.randint(1, 4)))
        out.append(f"http://{host}{rng.choice(['', '/', '/en/', '/en/7', '/de/8x', '/es/?a', '?/en/', '#'])}{rng.choice(['', '7', 'z/'])}")
    return out


def test_judged_pages_against_every_rule(spark):
    rows = list(enumerate(pages())) + [(5, "http://COM/en/1"), (None, "http://b.org/es/1")]
    got = U.judge_pages(spark.createDataFrame(rows, "page_id long, url string")).collect()
    show = lambda x: tuple(map(str, x))
    assert sorted(map(show, got)) == sorted(show((i, *plain(u, U.RULES))) for i, u in rows)


def listed(n):
    rng = random.Random(1)
    return [(f"{'sub.' * (k % 3)}h{k}.{rng.choice(['com', 'org'])}", rng.choice(["", "/a", "/a/b", f"/{k}"]), rng.choice(["block", "allow"])) for k in range(n)]


def test_large_list_and_a_filter_that_is_too_small(spark, monkeypatch):
    entries = listed(100_000)
    by_host = {h: (h, p, v) for h, p, v in entries}
    rng = random.Random(8)
    urls = []
    for _ in range(3000):
        h, p, _ = rng.choice(entries)
        urls.append(f"http://{rng.choice(['', 'www.', 'x'])}{h if rng.random() < 0.5 else 'un' + h}{rng.choice([p, '/z', p + '/q'])}")
    want = sorted(map(str, ((u, *plain(u, [by_host[s] for s in (parts(u)[0].split(".", k)[-1] for k in range(6)) if s in by_host])) for u in urls)))
    df, lists = spark.createDataFrame([(u,) for u in urls], "url string"), U.entries_of(spark, entries)
    assert sorted(str(tuple(r)) for r in U.url_filter(df, lists).collect()) == want
    keys = lists.select(U.canonical(F.col("host"), F.col("path")).alias("key"))
    words, n_blocks = U.bloom_filter(keys, "key", len(entries))
    probe = lambda df: df.where(U.might_contain(F.col("words"), F.col("key"), n_blocks)).count()
    assert probe(keys.crossJoin(F.broadcast(words))) == len(entries)
    absent = spark.range(50_000).select(F.concat(F.lit("absent"), "id").alias("key"))
    assert probe(absent.crossJoin(F.broadcast(words))) < 0.01 * 50_000  # false positives
    monkeypatch.setattr(U, "MAX_FILTER_WORDS", 64)  # passes nearly all to the exact join, which stays exact
    assert sorted(str(tuple(r)) for r in U.url_filter(df, lists).collect()) == want


def test_hosts_of_many_labels_empty_tables_and_clashing_columns(spark):
    began = time.time()
    df = spark.createDataFrame([("http://" + "a." * 100_000 + "com/en/",)], "url string")
    assert U.url_filter(df, U.entries_of(spark, U.RULES)).first()["verdict"] == "block" and time.time() - began < 30
    assert U.judge_pages(spark.createDataFrame([], "page_id long, url string")).collect() == []
    names = ("host", "key", "listed_rule", "words", "h")
    df = spark.createDataFrame([("http://a.com/en/", *names)], "url string, " + ", ".join(f"{c} string" for c in names))
    row = U.url_filter(df, U.entries_of(spark, U.RULES)).first()
    assert (row["host"], row["key"], row["words"], row["verdict"]) == ("a.com", "key", "words", "block")
    nothing = U.url_filter(df, U.entries_of(spark, []).limit(0)).first()
    assert (nothing["rule"], nothing["verdict"]) == (None, "allow")
    odd = spark.createDataFrame([(None, "/", "block"), ("", "", "block"), ("com", None, "allow"), ("COM", "", "block")], "host string, path string, verdict string")
    assert U.url_filter(df, odd).first()["rule"] == "com" and U.url_filter(df, odd).first()["verdict"] == "block"
