import json
import os

from fieldglass.sources import manifest, scans


def put(folder, name, devices, at, text=None):
    place = folder / name
    place.write_text(text or json.dumps({"discovery_id": name[:-5], "seed_ip": "10.0.0.1", "timestamp": "t", "devices": {f"h{i}": {"hostname": f"h{i}"} for i in range(devices)}, "scan_summary": {"elapsed": 2.5, "failed_count": 1}}))
    os.utime(place, (at, at))


def test_only_changed_documents_are_read(spark, tmp_path):
    folder, kept = tmp_path / "scans", str(tmp_path / "kept")
    folder.mkdir()
    for i in range(4):
        put(folder, f"s{i}.json", i, 1_700_000_000 + i)
    put(folder, "broken.json", 0, 1_700_000_000, "{not json")
    (folder / "other.txt").write_text("no scan")

    def same(read):
        rows, n = manifest.refreshed(spark, str(folder), kept)
        docs = scans.read_documents(spark, str(folder))
        assert n == read and manifest.listing(rows).collect() == scans.listing(docs).collect()
        assert sorted(map(tuple, manifest.summaries(rows).collect())) == sorted(map(tuple, scans.summaries(docs).collect()))

    same(5)
    same(0)
    put(folder, "s1.json", 7, 1_700_000_100)
    put(folder, "s9.json", 1, 1_700_000_100)
    same(2)
    os.remove(folder / "s0.json")
    same(0)
    put(folder, "s0.json", 3, 1_700_000_200)
    same(1)
