import json
import random

import numpy as np
import pytest

from fieldglass.sources import scans, split


def document(seed, n):
    rng = random.Random(seed)
    odd = ['plain', 'q"uote', "back\\slash", "br{ace", "]}", "ü ", "", "end\\", '\\"', "{[", "a:b"]
    text = lambda: rng.choice(odd) + rng.choice(odd)
    device = lambda i: {"hostname": f"h{i}", "mgmt_ip": text(), "platform": text(), "collector_data": {text() + str(k): {"raw": {text(): text()}, "parsed": {"l": [[text()], {"x": text()}]}} for k in range(rng.randrange(3))}}
    return {"discovery_id": text(), "params": {"a": {"devices": {"no": {}}}, "b": [{"c": 1}]}, "devices": {f"{text()}{i}": device(i) for i in range(n)}, "scan_summary": {"elapsed": 1.5, "failed": {text(): text()}}}


def effect(data, state):
    """The definition, byte by byte."""
    change = []
    for b in data:
        if state == split.OUT:
            change.append(1 if b in b"{[" else -1 if b in b"}]" else 0)
            state = split.IN if b == ord('"') else split.OUT
        else:
            change.append(0)
            state = split.IN if state == split.ESCAPED else split.ESCAPED if b == ord("\\") else split.OUT if b == ord('"') else split.IN
    return change, state


@pytest.mark.parametrize("seed", range(4))
def test_effects_of_ranges_cut_at_every_byte(seed):
    data = json.dumps(document(seed, 2), indent=seed % 2 * 2 or None, ensure_ascii=seed > 1).encode()
    want, end = effect(data, split.OUT)
    for cut in range(len(data) + 1):
        a, state = split.looked_at(data[:cut], split.OUT)
        b, last = split.looked_at(data[cut:], state)
        assert [*a, *b] == want and last == end
    rng = np.random.default_rng(seed)
    for _ in range(300):
        x = bytes(rng.choice(list(b'"\\{}[]a'), 12))
        for state in (split.OUT, split.IN, split.ESCAPED):
            if not _stray(x, state):
                want, end = effect(x, state)
                change, last = split.looked_at(x, state)
                assert change.tolist() == want and last == end


def _stray(data, state):
    """Whether a backslash stands outside of strings, which no document has."""
    for b in data:
        if state == split.OUT and b == ord("\\"):
            return True
        state = effect(bytes([b]), state)[1]
    return False


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_devices_are_those_of_whole_documents(spark, tmp_path, size):
    docs = {f"s{i}.json": document(i, 4 + 3 * i) for i in range(2)}
    for name, d in docs.items():
        (tmp_path / name).write_text(json.dumps(d, indent=2 if name == "s0.json" else None, ensure_ascii=name == "s0.json"))
    (tmp_path / "list.json").write_text('[{"devices": {"x": {}}}]')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"devices": {}}')
    (tmp_path / "note.txt").write_text("{")
    got = {}
    for r in split.devices(spark, str(tmp_path), size).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["device_ord"], r["name"], json.loads(r["device"])))
    want = {n: [(i, k, v) for i, (k, v) in enumerate(d["devices"].items())] for n, d in docs.items()}
    assert {n: sorted(x, key=lambda r: r[0]) for n, x in got.items()} == want
    whole = {(r["device_ord"], r["e"]["key"]) for r in scans.entries(scans.read_documents(spark, str(tmp_path)).where("filename = 's1.json'")).collect()}
    assert {(i, k) for i, k, _ in got["s1.json"]} == whole
