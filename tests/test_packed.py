import pytest
from refmill.operators.packed import packed_flag_counts, parse_packed, split_packed

CASES = [
    ("names", "Krufenandin, F. P.", ["Krufenandin, F. P."]),
    ("names", "Ivavenin, S.; Haljan, H.;Marm, A. G.", ["Ivavenin, S.", "Haljan, H.", "Marm, A. G."]),
    ("names", '"Ivas, Theodore ""Ted""";"Ivad, I. J."', ['Ivas, Theodore "Ted"', "Ivad, I. J."]),
    ("names", '["Vorn, Dmitri \\"Dima\\"", "Tar, A. H."]', ['Vorn, Dmitri "Dima"', "Tar, A. H."]),
    ("names", "Engras, U. P., Marm, D., Dref, O.", ["Engras, U. P.", "Marm, D.", "Dref, O."]),
    ("names", "Xenia Frolo,Yevgenia Dremu", ["Xenia Frolo", "Yevgenia Dremu"]),
    ("names", "Quizaluela, S. G. von; Tolhem, H.", ["Quizaluela, S. G. von", "Tolhem, H."]),
    ("names", "Ministry of Soil, Quarni; ", ["Ministry of Soil, Quarni"]),
    ("names", 'Leo Lorve, "Halgas, Fran L."', ["Leo Lorve", "Halgas, Fran L."]),
    ("codes", "A_B;;C_D | E_F,", ["A_B", "C_D", "E_F"]),
    ("codes", "[\"A\", \"B\"]", ["A", "B"]),
    ("messages", "pubmed: HTTPStatusError: 429, retry after 18 s | web: RuntimeError: x", ["pubmed: HTTPStatusError: 429, retry after 18 s", "web: RuntimeError: x"]),
    ("messages", '"crossref: E: a; b", web: F: c | d', ["crossref: E: a; b", "web: F: c | d"]),
    ("messages", '"web: KeyError: ""message"""', ['web: KeyError: "message"']),
]


@pytest.mark.parametrize("kind,text,want", CASES)
def test_grammar(kind, text, want):
    assert [v for v, _ in parse_packed(text, kind)] == want


def test_malformed_quotes_are_kept_and_flagged():
    assert parse_packed('"Open; Next', "names") == (('"Open', "malformed_quote"), ("Next", ""))
    assert parse_packed('"a"b; c', "codes")[0][1] == "malformed_quote"


def test_operator_edge_cases(spark):
    rows = [(1, "a;b", None, 9), (1, "a;b", None, 9), (2, "", " ", 9), (3, None, "x" * 30_000, 9)]
    df = spark.createDataFrame(rows, "id long, codes string, other string, pos int")
    got = split_packed(df, "id", {"codes": "codes", "other": "codes"}).collect()
    assert sorted((r.id, r.field_name, r.pos, len(r.item)) for r in got) == [(1, "codes", 1, 1), (1, "codes", 1, 1), (1, "codes", 2, 1), (1, "codes", 2, 1), (3, "other", 1, 30_000)]
    empty = split_packed(df.limit(0), "id", {"codes": "codes"})
    assert empty.columns == ["id", "field_name", "pos", "item", "flag"] and empty.count() == 0
    assert packed_flag_counts(split_packed(df, "id", {"codes": "codes"})).collect()[0].n == 4
