"""Odd hosts lose the same branches however many nodes there are to remove."""

import pytest

from graphloom.llm.html_text import main_text


@pytest.mark.parametrize("most", [200_000, -1])
def test_odd_hosts(spark, monkeypatch, most):
    monkeypatch.setattr("graphloom.llm.html_text.BROADCAST_NODES", most)
    urls = ["http://my_site.example/", "http://müller.example/", "http://plain.example/a b|c{d}", "http://[2001:db8::1]/", "http://UPPER.example:80/"]
    rows = [(100 * k + i, u, f"<body><div><p>Same words on {k}</p></div><section><p>Own text {k} {i}</p></section></body>") for k, u in enumerate(urls) for i in range(12)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {100 * k + i: f"Own text {k} {i}" for k in range(len(urls)) for i in range(12)}
