import math

import numpy as np
import pytest

from plumbline.llm import page_language as L

FR, EN = "le chat et la souris dans une maison avec un oiseau", "the cat and the mouse in a house with some birds"


@pytest.fixture
def model(table):
    rows = [(k, FR if k % 2 else EN, "fr" if k % 2 else "en") for k in range(20)] + [(90, None, "de"), (91, "x", None), (92, "", "es")]
    return L.train(table(rows, "doc_id int, text string, lang string"))


def pages(table, rows):
    return table([(k, *r) for k, r in enumerate(rows)], "page_id int, url string, html string")


def by_id(df):
    return {r.page_id: r for r in df.collect()}


def test_languages_of_the_model(model):
    assert model.languages == ("en", "fr")


def test_text_markup_and_host_are_fused(table, model):
    rows = [("http://a.example.fr/1", f'<html lang="fr"><p>{FR}</p>')] * 12 + [("http://b.example.com/1", f'<html lang="en"><p>{EN}</p>')] * 12
    rows += [("http://a.example.fr/2", ""), ("http://c.other.org/", "<html lang=fr><p>zzz"), (None, None)]
    got = by_id(L.identify(pages(table, rows), model))
    assert [got[k].lang for k in (0, 12, 24, 25)] == ["fr", "en", "fr", "fr"]
    assert got[24].text_lang is None and got[24].host == "a.example.fr" and got[25].declared == "fr"
    assert got[26].host is None and got[26].declared is None and 0.3 < got[26].score < 0.7


def test_posterior_equals_the_sums_by_hand(table, model):
    f = L.Fusion()
    rows = [("http://a.x.fr/1", f'<html lang="fr"><p>{FR}</p>'), ("http://a.x.fr/2", f"<p>{EN}</p>"), ("http://b.x.fr", "<html lang=zz>"), ("odd", f"<p>{FR}")]
    got = by_id(L.identify(pages(table, rows), model, fusion=f))

    def text(t):
        _, slots = L._grams([t], model.slots)
        n = len(slots)
        v = model.log_odds[:, slots].sum(axis=1) * (min(n, f.effective) / max(n, 1))
        return v - v.max()

    likely = [text(FR), text(EN), np.zeros(2), text(FR)]
    weight = [np.exp(v) / np.exp(v).sum() for v in likely]
    world = (sum(weight) + 1) / (sum(map(sum, weight)) + 2)
    domain = (weight[1] + weight[2] + 10 * world) / (3 - 1 + 10)
    host = (weight[1] + 10 * domain) / (2 - 1 + 10)
    markup = (weight[0] + 1) / (weight[0] + weight[2] + 1 * 3)
    address = (weight[0] + weight[1] + weight[2] + 1) / (weight[0] + weight[1] + weight[2] + f.suffixes)
    fused = np.log(host) + likely[0] + np.log(markup) + np.log(address)
    p = np.exp(fused - fused.max())
    assert math.isclose(got[0].score, p.max() / p.sum(), rel_tol=1e-9) and got[0].lang == "fr"


def test_hot_host_and_its_rest(table, model):
    rows = [("http://hot.com/", f"<p>{EN}")] * 30 + [(f"http://h{k}.org/", f"<p>{FR}") for k in range(10)]
    got = by_id(L.identify(pages(table, rows), model))
    assert len(got) == 40 and {got[k].lang for k in range(30)} == {"en"} and {got[k].lang for k in range(30, 40)} == {"fr"}


def test_given_pages(spark):
    d = "/root/testdata/sf0.001"
    model = L.train(spark.read.parquet(f"{d}/documents.parquet"))
    rows = L.identify(spark.read.parquet(f"{d}/pages.parquet"), model).collect()
    assert np.mean([r.lang == r.declared for r in rows]) > 0.97


def test_empty_tables_and_repeated_rows(table, model):
    none = pages(table, [])
    assert L.identify(none, model).count() == 0
    empty = L.train(table([], "doc_id int, text string, lang string"))
    row = L.identify(pages(table, [("http://a.b/", EN)]), empty).first()
    assert row.lang is None and row.score is None
    twice = table([(1, "u", EN)] * 2, "page_id int, url string, html string")
    assert L.identify(twice, model).count() == 2
