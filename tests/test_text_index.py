import pytest

from checks import tables
from dealflow.operators import search
from dealflow.operators.filters import ListingFilter
from dealflow.sources.text_index import TextIndex, fixed_parts, grams
from helpers import listings

TEXTS = ["Old Mill, 100% sold", "old_mill", "MILLER's back\\slash", "İstanbul ΟΔΟΣ Straße", None, "", "x", "mi", "a%b_c"]
ASKED = {
    1: "mill", 2: "MILL", 3: "old_mill", 4: "100\\%", 5: "%", 6: "mi", 7: "zzz", 8: "back\\\\slash", 9: "i̇stanbul", 10: "οδος",
    11: "straße", 12: "ll, 1", 13: "o_d%sold", 14: "", 15: "la", 16: "los angeles", 17: "a\\%b\\_c", 18: "e old",
}


def answers(df):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in df.select("query_id", "rank", "id").collect())


@pytest.fixture(scope="module")
def table(spark):
    rows = [{"title": t, "description": t and f"{t} again" if i % 2 else None, "city": "Los Angeles" if i % 9 == 3 else "Reno"} for i, t in enumerate(TEXTS * 4)]
    return listings(spark, *rows)


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_requests_equal_a_scan(spark, table, tmp_path, monkeypatch, share):
    import dealflow.sources.text_index as module

    monkeypatch.setattr(module, "SCANNED_SHARE", share)
    index = TextIndex.build(table, str(tmp_path / "i"))
    filters = ListingFilter(state="CA")
    found = index.search(table, ASKED, 5, filters)
    assert answers(found) == answers(search.text_search_many(table, ASKED, 5, filters))
    chosen, scanned = index.plan(ASKED)
    assert {5, 6, 14, 15} <= set(scanned) and 7 not in {*chosen, *scanned}
    assert (share < 1.0) or {1, 2, 9, 10, 11} <= set(chosen)


def test_documents(spark, tmp_path):
    table = tables.described(spark, "/root/testdata/sf0.001")
    index = TextIndex.build(table, str(tmp_path / "i"))
    asked = {1: "the and attion to thanedble", 2: "tion on", 3: "RENO", 4: "Document 17", 5: "no such text anywhere"}
    assert answers(index.search(table, asked, 10)) == answers(search.text_search_many(table, asked, 10))
    chosen, scanned = index.plan(asked)
    assert set(chosen) == {4} or 1 in chosen and 3 in scanned and 5 not in scanned


def test_empty(spark, table, tmp_path):
    index = TextIndex.build(table.limit(0), str(tmp_path / "i"))
    assert index.search(table.limit(0), ASKED).count() == 0
    assert index.search(table, {}).count() == 0


def test_fixed_parts_of_patterns():
    assert fixed_parts("%a\\%b%c_d%") == ["", "a%b", "c", "d", ""]
    assert fixed_parts("%back\\\\%x") == ["", "back\\", "x"]
    assert grams("abcd") == {"abc", "bcd"} and grams("ab") == set()


def test_postings_are_listed_by_letters(spark, table, tmp_path):
    from dealflow.sources.text_index import CODE, gram_codes

    for text in (*[t or "" for t in TEXTS], "a\U0001f600\x00b", "aaaa"):
        assert ["".join(chr(g >> CODE * k & (1 << CODE) - 1) for k in (2, 1, 0)) for g in gram_codes(text).tolist()] == sorted(grams(text))
    index = TextIndex.build(table.repartition(1), str(tmp_path / "i"))
    rows = [(r["gram"], r["ids"]) for r in index._postings().collect()]
    assert len(rows) == len({g for g, _ in rows}) and sum(len(ids) for _, ids in rows) > 4 * len(rows)
