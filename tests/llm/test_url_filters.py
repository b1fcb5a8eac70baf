"""Url rules and host propagation against plain Python."""

import re

import pytest

from connrisk.llm import url_filters as U
from connrisk.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(r), r, k) for k, r in URL_RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def rank(nodes, edges, seeds, damping, rounds):
    seed = {n: (1 / len(seeds) if n in seeds else 0.0) for n in nodes}
    out = {}
    for (a, _), w in edges.items():
        out[a] = out.get(a, 0) + w
    score = dict(seed)
    for _ in range(rounds):
        lost = sum(v for n, v in score.items() if n not in out)
        got = dict.fromkeys(nodes, 0.0)
        for (a, b), w in edges.items():
            got[b] += score[a] * w / out[a]
        score = {n: (1 - damping) * seed[n] + damping * (got[n] + lost * seed[n]) for n in nodes}
    return score


URLS = ["http://a.com/x", "https://www.Example.com/en/1?q=1#t", "http://example.com/en/", "http://example.com/fr/en/", "http://b.net/es/1",
        "http://net/fr/", "http://www.example.com/enough", "http://x.org", "http://x.org?y=/en/", "nothing", "", None, "://", "http://com/",
        "http://notcom/x", "http://y.org/a\nb", "ftp://EXAMPLE.COM/en/x://y", "http://É.com/é"]


@pytest.mark.parametrize("empty_html", [None, ""])
def test_hosts_paths_and_rules(llm, empty_html):
    rows = [(i, u, empty_html) for i, u in enumerate(URLS)]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    for r in U.judge(pages, URL_RULES).collect():
        host, path = split(URLS[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")


def test_scores_are_those_of_a_loop(llm):
    links = [("good.com", "mid.org"), ("mid.org", "far.org"), ("sly.org", "bad.net"), ("sly.org", "mid.org"), ("hub.org", "bad.net"),
             ("hub.org", "sly.org"), ("far.org", "good.com"), ("bad.net", "far.org")]
    rows, n = [], 0
    for a, b in links * 2 + links[:3]:
        path = "/es/p" if a == "bad.net" else "/p"
        rows.append((n, f"http://{a}{path}{n}", f'<a href="http://{b}/x">x</a><a href=/own>y</a><a HREF=\'mailto:a@{b}\'>'))
        n += 1
    rows.append((n, "http://lone.org/", None))
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    ruled = U.with_rules(pages, URL_RULES)
    edges = U.host_edges(pages)
    weights = {(r.src, r.dst): r.weight for r in edges.collect()}
    want = {}
    for a, b in links * 2 + links[:3]:
        want[a, b] = want.get((a, b), 0) + 1
    assert weights == want
    nodes = {x for e in want for x in e} | {"lone.org"}
    trust = rank(nodes, want, {"good.com"}, U.DAMPING, U.ROUNDS)
    distrust = rank(nodes, {(b, a): w for (a, b), w in want.items()}, {"bad.net"}, U.DAMPING, U.ROUNDS)
    found = {r.host: r for r in U.host_scores(ruled, edges).collect()}
    assert set(found) == nodes
    for host in nodes:
        assert found[host].trust == pytest.approx(trust[host], abs=1e-5)
        assert found[host].distrust == pytest.approx(distrust[host], abs=1e-5)
    verdicts = {r.host: r.verdict for r in U.judge(pages, URL_RULES).collect() if r.rule is None}
    assert verdicts == {h: "block" if distrust[h] > 0.5 * (trust[h] + distrust[h]) else "allow" for h in verdicts}
    assert verdicts["sly.org"] == "block" and verdicts["mid.org"] == "allow" == verdicts["lone.org"]


def test_propagation_goes_on_until_it_converges(llm):
    """A chain of 30 hosts to a blocked seed, all of whose hosts are suspect, and a cycle that has not settled after 20 rounds."""
    rows = [(i, f"http://h{i}.org/", f'<a href="http://{"bad.net" if i == 0 else f"h{i - 1}.org"}/es/x">') for i in range(30)]
    rows += [(100, "http://bad.net/es/x", None)]
    rows += [(200, "http://good.com/", '<a href="http://a.io/">'), (201, "http://a.io/", '<a href="http://b.io/">'),
             (202, "http://b.io/", '<a href="http://a.io/">')]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    found = {r.host: r for r in U.host_scores(U.with_rules(pages, URL_RULES), U.host_edges(pages)).collect()}
    assert all(found[f"h{i}.org"].distrust > 0 == found[f"h{i}.org"].trust for i in range(30))
    # good = 0.15, a = 0.85 (good + b), b = 0.85 a
    a = 0.85 * 0.15 / (1 - 0.85**2)
    assert found["a.io"].trust == pytest.approx(a, rel=1e-5) and found["b.io"].trust == pytest.approx(0.85 * a, rel=1e-5)


def test_empty_and_null_tables(llm):
    schema = "page_id long, url string, html string"
    assert U.judge(llm.createDataFrame([], schema), URL_RULES).count() == 0
    rows = U.judge(llm.createDataFrame([(None, None, None)] * 2, schema), URL_RULES).collect()
    assert [tuple(r) for r in rows] == [(None, "", "", None, "allow")] * 2
