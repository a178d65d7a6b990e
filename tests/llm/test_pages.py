"""URL rules and archives against plain Python."""

import hashlib
import io

import pytest

from plumbline.llm import archives, url_rules
from plumbline.llm.queries import URL_RULES
from plumbline.session import shared_dir

URLS = ["http://A.Example.net/en/1?x=1", "https://example.net/fr/2#t", "ftp://b.example.com/de/3", "http://x.org/fr/4",
        "http://x.net", "x.net/en", None, "", "://", "http://notexample.net/en/5", "http://spam.org/win/6?ref=a",
        "http://spam.org/win/7?ref=b", "http://spam.org:80/win/8", "http://org/fr/", "a://b://c.net/d"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest.split("/")[0].split("?")[0].split("#")[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in URL_RULES:
        domain, tail = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail):
            best = max(best or ("", ""), (rule, verdict), key=lambda r: len(r[0]))
    return host, path, best


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, f"<p>{i}</p>", None) for i, u in enumerate(URLS)] + [(None, URLS[0], None, None), (3, URLS[3], "a", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string").drop("host")


def test_rules(spark, pages):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, URL_RULES, url_rules.mine(url_rules.labelled_urls(pages, labels))).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, best = judged(URLS[r["page_id"]] if r["page_id"] is not None else URLS[0])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == (best[1] if best else "allow")
    empty = pages.limit(0)
    assert url_rules.judge(empty, URL_RULES, url_rules.mine(url_rules.labelled_urls(empty, labels))).count() == 0


def test_mined_rules(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}.org/{'win' if i % 2 else 'news'}/{i}", None) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, int(not (i % 3 == 0 and i % 2)), None) for i in range(0, 120)] + [(None, 0, 1), (5, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    mined = url_rules.mine(url_rules.labelled_urls(pages, labels))
    found = {tuple(r["rule_tokens"]): (r["rule_support"], r["rule_confidence"]) for r in mined.collect()}
    assert found[("h:spam", "p:win")] == (20, 1.0) and found[("h:spam",)] == (20, 0.5)
    got = {r["page_id"]: r for r in url_rules.judge(pages, [], mined).collect()}
    assert got[3]["verdict"] == "block" and got[3]["mined_rule"] == "h:spam p:win"
    assert got[1]["verdict"] == "allow" and got[1]["mined_rule"] is None


@pytest.mark.parametrize("sent", [archives.BROADCAST_ROWS, 0])
def test_archives(spark, monkeypatch, sent):
    """In one pass and by a join; payloads that recur, a null page, columns with names of the operator's own."""
    monkeypatch.setattr(archives, "BROADCAST_ROWS", sent)
    big = "x" * 1500
    rows = [(1, "http://a/b c", big), (2, "http://a/2", big), (9, None, big), (3, "http://a/3", "short"), (4, "http://a/4", "short"),
            (5, "http://a/5", None), (6, "http://a/6", "a\r\n\r\nWARC/1.1\r\n\n1 0 x é" * 100), (None, "http://a/7", big), (9, "u", big),
            (11, "http://a/11", "Z" * 300_000), (12, "http://a/12", "é" * 900_000), (13, "", "é" * 900_000)]
    pages = spark.createDataFrame([(*r, "other", "other", None) for r in rows],
                                  "page_id long, url string, html string, digest string, payload string, refers_to string").repartition(3)
    where = f"{shared_dir(spark)}/test-archives-{id(pages)}-{sent}"
    archives.write_arc(pages, f"{where}/arc")
    archives.convert(spark, f"{where}/arc", f"{where}/warc")
    got = sorted((tuple(r) for r in archives.warc_pages(spark, f"{where}/warc").collect()), key=str)
    want, last = [], {big: 9, rows[-1][2]: 13}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        revisit = html in last and page_id != last[html]
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response",
                     last[html] if revisit else None))
    assert got == sorted(want, key=str)


def test_dates():
    assert archives.iso_date("20240131235901") == "2024-01-31T23:59:01Z"
    with pytest.raises(ValueError):
        archives.iso_date("2024-01-31")


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    where = f"{shared_dir(spark)}/test-archives-{id(empty)}"
    archives.write_arc(empty.repartition(2), f"{where}/arc")
    archives.convert(spark, f"{where}/arc", f"{where}/warc")
    assert archives.warc_pages(spark, f"{where}/warc").count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = archives.version_block(version, "f.arc") + b"\n" + archives.arc_record(version, "f.arc", 7, "http://a b", b"x\ny") + b"\n"
    (head, block), = archives.read_arc(io.BytesIO(data))
    assert head["URL"] == "http://a%20b" and len(head) == (5 if version == 1 else 10)
    assert block.endswith(b"\r\n\r\nx\ny")
    with pytest.raises(ValueError):
        list(archives.read_arc(io.BytesIO(data[:-3])))
