import math
from collections import Counter

from inkstone.llm import license as L


def test_bound_never_loses_a_match():
    matcher = L.Matcher(L.TEMPLATES, 1000, {"license": 20, "the": 900, "of": 800, "under": 50})
    for text in ("Released under the MIT License", "licensed under the GNU general public license version 3", "the of the of", "all rights reserved by us", "MIT license of the river"):
        words = L.words_of(text)
        v = {w: n * matcher.idf.get(w, matcher.rare) for w, n in Counter(words).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        best = max(sum(x * t.get(w, 0) for w, x in v.items()) / size for _, t in matcher.templates)
        found = matcher.best(words)
        assert (found is not None) == (best >= L.SIMILAR) and (found is None or abs(found[0] - best) < 1e-8)


def test_nearest_ancestor_wins(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x", "plain words here and more of them"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/y", None), (5, "z/y", ""), (6, None, "text"), (7, "a/b/own", "many words that say nothing at all about it and go on\nAll rights reserved."), (8, "top", "words only"),
    ]
    out = {r["id"]: (r["license"], r["origin"], r["from_dir"]) for r in L.inherited(L.notices(spark.createDataFrame(rows, "id long, path string, text string"))).collect()}
    assert out[1][:2] == ("MIT", "header") and out[2] == ("Apache-2.0", "inherited", "a/b") and out[4] == ("MIT", "inherited", "a")
    assert out[5] == (None, "none", None) and out[6] == (None, "none", None) and out[7][:2] == ("Proprietary", "header") and out[8][1] == "none"


def test_whole_licence_texts_speak_for_their_directory(spark):
    rows, want = [], {}
    for k, (name, text) in enumerate((name, t) for name, ts in sorted(L.WHOLE.items()) for t in ts):
        lines = text.replace("Copyright.", f"Copyright (c) 2024 Jo Doe {k}").replace(". ", ".\n")
        rows += [(2 * k, f"d{k}/LICENSE", lines), (2 * k + 1, f"d{k}/src/main", "plain words here and nothing else of note")]
        want |= {2 * k: (name, "header"), 2 * k + 1: (name, "inherited")}
    plain = [(100 + i, f"p/{i}", "the program and the files of any person with no conditions " * 20 + str(i)) for i in range(200)]
    out = {r["id"]: r for r in L.inherited(L.notices(spark.createDataFrame(rows + plain, "id long, path string, text string"))).collect()}
    assert {k: (out[k]["license"], out[k]["origin"]) for k in want} == want and all(out[i]["license"] is None for i, _, _ in plain)


def test_licences_keep_their_names_under_any_word_frequencies():
    vocabulary = {w for ts in L.TEMPLATES.values() for t in ts for w in L.words_of(t)}
    whole = L.WholeTexts(L.WHOLE)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unicode-3.0"} <= set(L.WHOLE)
    for n, seen in ((1000, {}), (10**9, {}), (10**9, dict.fromkeys(vocabulary, 10**9)), (1000, {"the": 900, "of": 800, "license": 5})):
        matcher = L.Matcher(L.TEMPLATES, n, seen)
        for name, texts in L.WHOLE.items():
            for text in texts:
                changed = "Copyright (c) 1999-2024 Some Body <some@body.example>\n\n" + text.replace(" and ", " and\n")
                assert matcher.notice(changed, whole)[1:] == (name, True)
        # words of licences in any other text make no licence file
        assert matcher.notice("The licence of the software and the use of any copy in the work. " * 40, whole)[2] is False


def test_reserved_rights_give_way():
    matcher = L.Matcher(L.TEMPLATES, 1000, {"the": 900})
    assert matcher.notice("All rights reserved.\nThis file is released under the MIT License.\n" + "more words\n" * 20)[1] == "MIT"
    assert matcher.notice("All rights reserved.\n" + "more words\n" * 20)[1:] == ("Proprietary", False)


def brute(files, templates, similar):
    """(license, cosine, is_file) of each text by plain dictionaries, all templates against all segments and the whole."""
    total = len(files)
    seen = Counter(w for t in files for w in set(L.words_of(t or "")))

    def cosine(words, template):
        idf = lambda w: math.log((total + 1) / (seen[w] + 1)) + 1 if w in vocabulary else math.log(total + 1) + 1
        a, b = ({w: n * idf(w) for w, n in Counter(x).items()} for x in (words, L.words_of(template)))
        norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / norm if norm else 0.0

    vocabulary = {w for ts in templates[0].values() for t in ts for w in L.words_of(t)}
    texts = [Counter(L.words_of(t)) for ts in templates[1].values() for t in ts]
    among = {w: sum(w in c for c in texts) for c in texts for w in c}

    def alike(words, template):
        weight = lambda w, n: (1 + math.log(n)) * (math.log((len(texts) + 1) / (among.get(w, 0) + 1)) + 1)
        a, b = ({w: weight(w, n) for w, n in Counter(x).items()} for x in (words, L.words_of(template)))
        return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    def best(words, known, measure, least):
        each = [(name == "Proprietary", -round(measure(words, t), 9), name) for name, ts in known.items() for t in ts]
        top = min((e for e in each if -e[1] >= least), key=lambda e: e[1:], default=None)
        return top

    out = []
    for text in files:
        segments = [L.words_of(x) for x in L._SEGMENT.split(text or "")]
        every = [w for x in segments for w in x]
        hits = [(best(x, templates[0], cosine, similar), len(x)) for x in segments if x]
        hits = [(b, n) for b, n in hits if b]
        if every and (found := best(every, templates[1], alike, L.ALIKE)):
            out.append((found[2], -found[1], True))
        elif hits:
            top = min(b for b, _ in hits)
            out.append((top[2], -top[1], 2 * sum(n for _, n in hits) >= len(every)))
        else:
            out.append((None, None, False))
    return out


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    want = brute([t for _, t in docs], (L.TEMPLATES, L.WHOLE), L.SIMILAR)
    got = {r["doc_id"]: r for r in L.op4_license(spark, d).collect()}
    assert any(w[0] for w in want)
    for (i, _), (name, cosine, is_file) in zip(docs, want, strict=True):
        r = got[i]
        assert (r["license"] if r["origin"] == "header" else None) == name and r["is_file"] == is_file and (cosine is None or abs(r["cosine"] - cosine) < 1e-6)
