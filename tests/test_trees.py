from fieldglass import queries
from fieldglass.plans import l3
from tests.compare import differences, duck


def test_audit_by_trees_of_any_size(spark, sf_dir, monkeypatch):
    """Overlaps are those of the SQL where some networks are listed whole and larger ones by those above and below."""
    monkeypatch.setattr(l3, "TREE", 3)
    name = "J10_address_audit"
    assert differences(spark, duck(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_small_trees_send_no_lists_of_overlaps(spark, sf_dir, monkeypatch):
    """Interfaces of small networks are not listed for each network above and below."""
    sizes, real = [], l3.around
    monkeypatch.setattr(l3, "around", lambda df, *a: sizes.append(df) or real(df, *a))
    l3.address_audit(queries.Scans(spark, sf_dir))
    assert [df.count() for df in sizes] == [0]
