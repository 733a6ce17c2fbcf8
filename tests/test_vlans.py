from fieldglass import queries
from fieldglass.plans import l2

SMALL = "/root/testdata/sf0.001"


def test_numbers_of_vlans_need_no_texts(spark, monkeypatch):
    """Places are those of the documentation; numbering makes no document."""
    t = queries.Scans(spark, SMALL)
    rows = lambda df: sorted(map(str, df.select("scan_id", "vlan_id", "place").collect()))
    assert rows(l2.vlan_places(t)) == rows(l2.vlan_documentation(t))
    monkeypatch.setattr(l2, "vlan_documentation", None)
    assert queries.QUERIES["O2_order_of_vlans"](spark, SMALL).count() > 0


def test_documentation_from_pieces_of_any_size(spark, monkeypatch):
    """Texts joined from many pieces are those of one piece, and no piece holds more rows than its range."""
    rows = lambda: sorted(map(str, l2.vlan_documentation(queries.Scans(spark, SMALL)).collect()))
    monkeypatch.setattr(l2, "PIECES", 1_000_000)
    want, seen = rows(), []
    real = l2.pieces
    monkeypatch.setattr(l2, "PIECES", 25)
    monkeypatch.setattr(l2, "pieces", lambda df, *a: seen.append(df) or real(df, *a))
    assert rows() == want
    assert all(df.select("__part").distinct().count() > 5 for df in seen) and len(seen) == 4
