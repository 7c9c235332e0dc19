"""Operator 7's rules, word by word as its contract lists them."""

from __future__ import annotations

from veriframe.llm.url_filter import RULES, judge_urls

CONTRACT = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_verdicts_of_the_contract(spark):
    assert RULES == CONTRACT
    urls = [(f"https://{sub}{host}{path}{rest}", host + path, verdict) for host, path, verdict in CONTRACT for sub in ("", "www.") for rest in ("", "0?q")]
    got = judge_urls(spark.createDataFrame(urls, "url string, rule string, verdict string"), default="block").select("url", "_rule", "_verdict").collect()
    assert sorted(map(tuple, got)) == sorted(urls)
