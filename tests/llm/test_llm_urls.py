import re

import pytest

from carryover.llm import urls as U

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
CASES = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/17?x=1", "https://badexample.org/es/", "https://x.com/fr/1#t", "http://x.COM/de/2", "http://org", "http://org/",
         "ftp://a.b/c://d", "no scheme", "", None, "http://É.org/x", "x://h?q/p", "http://casino-win.example.net/en/4", "http://www.gardens.example.net/en/4\n"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for says, r in RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (says, r)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(CASES)], "page_id long, url string, host string, verdict string")
    model = U.train_urls(spark.createDataFrame(list(U.LABELLED), "url string, label int"))
    got = {r.page_id: r for r in U.url_filter(pages, model, RULES).collect()}
    assert len(got) == len(CASES)
    for i, u in enumerate(CASES):
        host, path, best = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1] if best else None), u
        assert got[i].verdict == (best[0] if best else "block" if got[i].p_block >= 0.5 else "allow")
    assert got[13].verdict == "block" and got[14].verdict == "allow" and got[10].verdict == "allow"
    assert U.url_filter(pages.limit(0), model, RULES).count() == 0


def test_held_out_hosts():
    model = U.fit_urls([u.split("/")[2] for u, _ in U.LABELLED], ["/" + u.split("/", 3)[3] for u, _ in U.LABELLED], [y for _, y in U.LABELLED])
    import pyarrow as pa

    bad, fine = ["casino-win.example.com", "m.free-bets.example.net", "www.spam-farm.example.com"], ["www.orchard.example.net", "therer.example.com"]
    p = model.probability(pa.array(bad + fine), pa.array(["/en/12"] * 5))
    assert (p[:3] > 0.5).all() and (p[3:] < 0.5).all()


def test_large_tables_are_an_error(monkeypatch):
    monkeypatch.setattr(U, "MAX_LABELLED", 3)
    with pytest.raises(ValueError, match="more than 3"):
        U.fit_urls(["a"] * 4, ["/"] * 4, [0, 1, 0, 1])


def test_urls_unwanted_by_path_alone():
    import pyarrow as pa

    model = U.fit_urls([u.split("/")[2] for u, _ in U.LABELLED], ["/" + u.split("/", 3)[3] for u, _ in U.LABELLED], [y for _, y in U.LABELLED])
    bad, fine = ["/online-casino/bonus", "/en/casino-win/7", "/x/best-slots.html"], ["/science/museum", "/en/garden-history/7", "/x/railways.html"]
    p = model.probability(pa.array(["www.example.com"] * 6), pa.array(bad + fine))
    assert (p[:3] > 0.5).all() and (p[3:] < 0.5).all(), p
    assert not {"ads-track", "free-bets", "spam-farm", "cheap-pills"} & set(U.UNWANTED)
