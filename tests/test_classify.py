"""Every bot-guard marker is seen, and the type of a source counts in a page's complexity."""

import pytest

from tidewire.operators.classify import flags

MARKERS = ("cloudflare", "cf-ray", "cf-cache-status", "datadome", "qrator", "qrator_jsr", "__qrator", "jsid", "akamai", "incapsula")


def test_markers(spark):
    pages = spark.createDataFrame([(m, f"<p>{m.upper()}</p>") for m in MARKERS] + [("none", "<p>plain</p>")], "m string, html string")
    assert {r["m"]: r["antibot"] for r in flags(pages, "html").collect()} == dict.fromkeys(MARKERS, True) | {"none": False}


def test_source_types(spark):
    cases = [
        ("https://api.a.org/x", None, "p", "api", 0.1), ("https://a.org", "Kad.arbitr.ru", "p", "registry", 0.4), ("https://lenta.ru/1", None, "p", "news", 0.2),
        ("https://a.org", "news", "nuxt", "spa", 0.7), (None, None, "p", "unknown", 0.0), ("https://nalog.ru", None, "nuxt captcha akamai", "registry", 1.0),
    ]
    pages = spark.createDataFrame(cases, "url string, name string, html string, kind string, score double")
    for r in flags(pages, "html", "url", "name").collect():
        assert (r["source_type"], r["complexity"]) == (r["kind"], pytest.approx(r["score"]))
