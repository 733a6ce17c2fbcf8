import math
import unicodedata
import zlib
from collections import Counter, defaultdict

from fieldglass.llm import langid


def test_held_out_languages(docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.digest(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    known = {x for x in lang.values() if x}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["lang_pred"] in known | {"und"} and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held)


def test_odd_rows(odd, none, docs):
    rows = langid.digest(odd).collect()
    assert len(rows) == odd.count()
    assert langid.digest(none).collect() == []
    model = langid.learn(docs.select("text", "lang"))
    by = {r["text"]: r for r in langid.identified(odd, model).collect()}
    assert by[None]["lang_pred"] == by[""]["lang_pred"] == by[" "]["lang_pred"] == "und" and by[""]["score"] == 0
    assert all(r["lang_pred"] == "und" for r in langid.identified(odd, langid.learn(none.select("text", "lang"))).collect())


def test_spans_of_mixed_texts(spark, docs):
    model = langid.learn(docs.select("text", "lang"))
    of = {x: docs.where(f"lang = '{x}' and n_chars between 400 and 2000").orderBy("doc_id").first()["text"] for x in ("en", "de")}
    text = f"{of['en']} {of['de']}"
    spans = langid.language_spans(spark.createDataFrame([(text,)], "text string"), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"]
    assert abs(spans[0]["end"] - len(of["en"])) < 60 and spans[-1]["end"] <= len(text)


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        scores = rng.normal(size=(n, 3)) * 12
        doc = np.sort(rng.integers(0, 2, n))
        label = langid.label_words(scores, doc)

        def value(path):
            return sum(scores[i, p] for i, p in enumerate(path)) - langid.PENALTY * sum(path[i] != path[i - 1] and doc[i] == doc[i - 1] for i in range(1, n))

        assert abs(value(label) - max(map(value, itertools.product(range(3), repeat=n)))) < 1e-6


def mixed(x):
    m = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def words_of(text):
    """(start, letters, buckets of trigrams, script of the first letter) of every word."""
    out, i = [], 0
    letter = [unicodedata.category(c)[0] == "L" for c in text]
    low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text]
    script = lambda c: next((k for k, r in langid.SCRIPTS.items() if any(a <= ord(c) <= b for a, b in r)), "")
    while i < len(text):
        j = i
        while j < len(text) and letter[j]:
            j += 1
        if j > i:
            w = [0, *low[i:j], 0]
            out.append((i, j, [mixed((w[k - 1] << 42) | (w[k] << 21) | w[k + 1]) >> 48 for k in range(1, len(w) - 1)], [script(c) for c in text[i:j]]))
        i = max(j, i + 1)
    return out


def test_counts_scores_and_paths_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.where("doc_id < 400").collect()]
    grams, scripts = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            for _, _, buckets, names in words_of(text):
                grams[lang].update(buckets)
                scripts[lang].update(names)
    langs = sorted(grams)
    log = {x: (lambda n, t: lambda b: math.log((n[b] + langid.SMOOTHING) / (t + langid.SMOOTHING * langid.BUCKETS)))(grams[x], sum(grams[x].values())) for x in langs}
    ours = {s: [x for x in langs if scripts[x][s] >= langid.SCRIPT_SHARE * sum(scripts[x].values())] for s in [*langid.SCRIPTS, ""]}
    got = {r["doc_id"]: r for r in langid.digest(docs.where("doc_id < 400")).collect()}
    for i, text, _ in rows:
        words = words_of(text)
        best, back = None, []
        for _, _, buckets, names in words:
            score = {x: sum(map(log[x], buckets)) for x in langs}
            if ours[names[0]]:
                least = min(score.values()) - 4 * langid.PENALTY
                score = {x: score[x] if x in ours[names[0]] else least for x in langs}
            if best is None:
                best = score
            else:
                top = max(langs, key=best.get)
                back.append({x: x if best[x] >= best[top] - langid.PENALTY else top for x in langs})
                best = {x: max(best[x], best[top] - langid.PENALTY) + score[x] for x in langs}
        if not words:
            assert got[i]["lang_pred"] == "und" and got[i]["spans"] == ""
            continue
        path = [max(langs, key=best.get)]
        for step in reversed(back):
            path.append(step[path[-1]])
        letters = Counter()
        spans = []
        for x, (a, b, _, _) in zip(reversed(path), words):
            letters[x] += b - a
            if spans and spans[-1][2] == x:
                spans[-1][1] = b
            else:
                spans.append([a, b, x])
        assert got[i]["spans"] == ",".join(f"{a}:{b}:{x}" for a, b, x in spans), i
        assert letters[got[i]["lang_pred"]] == max(letters.values())
        assert abs(got[i]["score"] - max(letters.values()) / sum(letters.values())) < 1e-12
