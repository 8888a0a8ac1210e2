"""Operators that judge each row on its own: pages, URLs, tokens, personal data, quality, benchmark items."""

import random
import re

import numpy as np
import pytest

from marketloom.llm import decontam, html_pages, html_text, pii, quality, token_count, url_filter


# --- HTML -------------------------------------------------------------------


def test_blocks_of_broken_markup():
    html = "<title>no</title><script>if (a<b) '</p>'</script><p>one &amp; two<br>three<p><b>four<!-- x --> five</b></div><ul><li>six<li>seven"
    assert [b.text for b in html_text.blocks_of(html)] == ["one & two three", "four five", "six", "seven"]
    assert html_text.blocks_of(None) == [] and html_text.blocks_of("") == []
    assert [b.text for b in html_text.blocks_of("a < b &copy; 3 \n 4 <p title='x>y'>z")] == ["a < b © 3 4", "z"]


def test_long_pages_are_read_in_linear_time():
    assert len(html_text.blocks_of("<p>x" * 50_000)) == 50_000
    html_text.blocks_of('<a href="' * 20_000)
    html_text.blocks_of("<!--" * 50_000)


def test_text_after_many_unclosed_options_is_kept():
    texts = lambda html: [b.text for b in html_text.blocks_of(html)]
    assert texts("<select>" + "<option>x" * 1000 + "</select><p>article") == ["article"]
    assert texts("<select>" + "<optgroup label=a><option>x" * 1000 + "</select><p>article") == ["article"]
    assert texts("<svg>" * 1000 + "</svg>" * 1000 + "<p>article") == ["article"]
    assert texts("<div>" * 250 + "<svg>" + "<g>x" * 900 + "</svg><p>article") == ["article"]


def test_deep_and_unclosed_elements_hide_nothing():
    texts = lambda html: [b.text for b in html_text.blocks_of(html)]
    deep = "<div>" * 220 + "<noscript>" + "<div>" * 200 + "</div>" * 200 + "</noscript>" + "</div>" * 220
    assert texts(deep + "<p>one<p>two") == ["one", "two"]
    assert texts("<html><head><title>t</title><p>Body</p>") == ["Body"]
    assert texts("<head><meta charset=x><style>p{}</style>Body <b>runs</b> on") == ["Body runs on"]
    assert texts("<head><noscript><img src=x>no</noscript><title>t</title></head><body><p>Body") == ["Body"]
    assert texts("<!-->a<p>b<!--->c<!-- x -- y -->d") == ["a", "bcd"]
    assert len(texts("<div>x" * 30_000)) == 30_000
    assert texts("<svg>" * 30_000 + "</svg>" * 30_000 + "<p>article") == ["article"]


def test_sentences_run_on_around_what_is_passed_over():
    for k in ("<script>x('</p>')</script>", "<svg><g><p>x</p></g></svg>", "<noscript><p>no</p></noscript>", "<button><div>Share</div></button>", "<select><option>a<option>b</select>", "<style>p{}</style>", "<template><p>q</p></template>"):
        assert [b.text for b in html_text.blocks_of(f"<p>First part {k} goes on here.<p>next")] == ["First part goes on here.", "next"]
    assert [b.text for b in html_text.blocks_of("<div><p>one <noscript>no</p>two</div>three")] == ["one", "two", "three"]


_RIVER = "<p>The river runs through the old town and down to the sea, where the boats lie.</p>" * 3


def test_comments_behind_many_open_elements():
    model = html_text.trained()
    comment = "<p>I think this is wrong, says one reader.</p><p>So do I, and I have said so before.</p><p>Thanks for the post!</p>"
    for n in (90, 120, 150, 250, 3000):
        page = "<div>" * 205 + "<div class='comments'><div class='comment'>" + "<div>" * n + comment + "</div>" * n + f"</div></div><article>{_RIVER}</article>"
        assert html_text.main_texts([page], model)[0][1:] == (6, 3)
    assert len(html_text.page_codes(html_text.blocks_of("<div class=a>x" * 30_000))[4]) == 2


def test_parts_in_other_languages_and_open_dialogs():
    model = html_text.trained()
    german = (
        f'<div id="kopfzeile"><a href="/">Startseite</a></div><article>{_RIVER}</article><div class="werbung"><p>Jetzt Boote kaufen, nur diese Woche.</p></div>'
        '<div class="kommentare"><div class="kommentar"><p>Sehr guter Text, danke.</p></div></div><div id="fusszeile"><p>Impressum: Verlag Beispiel.</p></div>'
    )
    dialog = f"<dialog open><p>We use cookies. Accept all.</p></dialog><article>{_RIVER}</article>"
    want = "\n\n".join(["The river runs through the old town and down to the sea, where the boats lie."] * 3)
    for page in (german, german.replace("<article>", "<div class='x1'>").replace("</article>", "</div>"), dialog):
        assert html_text.main_texts([f"<html><body>{page}</body></html>"], model)[0][0] == want


def test_parts_whose_names_say_nothing(monkeypatch):
    r = np.random.default_rng(9)
    names = {k: tuple("".join(r.choice(list("abcdefghij"), 7)) for _ in range(9)) for k in html_pages.PART_NAMES}
    monkeypatch.setattr(html_pages, "PART_NAMES", names)
    held = html_text.made_up_pages(150, 78)
    p = np.concatenate(html_text.trained().probabilities([c for c, _ in held]))
    y = np.concatenate([y for _, y in held])
    assert (p[y == 1] >= 0.5).mean() > 0.96 and (p[y == 0] < 0.5).mean() > 0.95


def test_all_words_of_a_block_count():
    long, head = "<p>" + "menu " * 40 + "article " * 400, "<p>" + "menu " * 40
    a, b = (html_text.page_codes(html_text.blocks_of(x)) for x in (long, head))
    assert a[3][0] > 440 and np.isin(b[2][:1], a[2]).all()
    model = html_text.Labeller(2)
    whole = model.vectors(a)
    table, codes, sizes = model.p["table"], a[2], a[3]
    assert np.allclose(whole[0, html_text.VECTOR :], table[codes].sum(axis=0) / sizes[0])
    html_text.WORDS_AT_ONCE, kept = 7, html_text.WORDS_AT_ONCE
    try:
        assert np.allclose(model.vectors(a), whole)
    finally:
        html_text.WORDS_AT_ONCE = kept


def test_pages_with_clashing_columns_and_repeats(spark):
    page = "<html><body><article>" + "<p>The river runs through the old town and down to the sea.</p>" * 3 + "</article></body></html>"
    rows = [(1, page, "old", 7), (1, page, "old", 7), (2, None, None, None)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string, N_CHARS long"))
    assert got.columns == ["page_id", "html", "text", "n_chars", "n_blocks", "n_main"]
    one, two, none = sorted((tuple(r)[2:] for r in got.collect()), reverse=True)
    assert one == two and one[1] == len(one[0]) and none == ("", 0, 0, 0)


def test_formulae_stay_in_their_sentence():
    html = "<p>so <math><semantics><mrow><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mn>4</mn></mrow><annotation encoding='tex'>x^2=4</annotation></semantics></math> holds<p>next"
    assert [b.text for b in html_text.blocks_of(html)] == ["so x2=4 holds", "next"]
    assert [b.text for b in html_text.blocks_of("<p>a<annotation>" * 3)] == ["a", "a", "a"]


def test_gradients_of_the_labeller():
    model = html_text.Labeller(1)
    data = html_text.made_up_pages(3, 5)
    pages, labels = [c for c, _ in data], [y for _, y in data]
    _, g = model.gradients(pages, labels)
    rng = np.random.default_rng(0)
    for name in ("wf", "wb", "cf", "cb", "out", "bias"):
        at = tuple(rng.integers(0, n) for n in model.p[name].shape)
        model.p[name][at] += 1e-5
        up = model.gradients(pages, labels)[0]
        model.p[name][at] -= 2e-5
        down = model.gradients(pages, labels)[0]
        model.p[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-7)


def test_labeller_on_held_out_pages_and_page_table(spark, sf_dir):
    model = html_text.trained()
    held = html_text.made_up_pages(100, 77)
    p = np.concatenate(model.probabilities([c for c, _ in held]))
    assert ((p >= 0.5) == np.concatenate([y for _, y in held])).mean() > 0.97
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for row in html_text.extract_text(pages).select("html", "text", "n_chars").collect():
        inside = re.search(r"<article>(.*)</article>", row.html, re.S).group(1)
        blocks = (" ".join(__import__("html").unescape(re.sub("<br>", " ", x).replace("<b>", "")).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert row.text == "\n\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<nav><a href=x>Home</a></nav>")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_text.extract_text(pages).collect()] == [("", 0)] * 3
    assert html_text.extract_text(pages.limit(0)).count() == 0


# --- URLs -------------------------------------------------------------------


def test_rules_and_vocabulary(spark):
    cases = {
        "http://A.Example.com/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"), "http://x.org/porn": ("x.org", "/porn", None, "block"), "http://cheap-pills.org/": ("cheap-pills.org", "/", None, "block"),
        "http://essex.org/sussex": ("essex.org", "/sussex", None, "allow"), "http://free.org/free": ("free.org", "/free", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://notcom/": ("notcom", "/", None, "allow"), "http://com": ("com", "", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got == cases
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_weights_languages_and_harmless_urls(spark):
    blocked = [
        "http://a.org/cheap%20pills", "http://a.org/?q=free+bets", "http://ads.track.a.org/", "http://a.org/%D0%9F%D0%9E%D0%A0%D0%9D%D0%9E", "http://a.org/最新色情片",
        "http://a.org/online-wetten/bonus", "http://a.org/crédit-rencontres", "http://a.org/" + "x/" * 100_000 + "porn",
        "https://a.org/?q=1&ref=https://casino.com/", "http://a.org/?utm_campaign=casino", "http://a.org/?ref=casino-porn", "http://casino1.org/", "http://24xxx7.org/",
        "http://xn--80aodfsg.example/", "http://a.xn--m1abbbg.example/x", "http://spam-farm.org/", "http://adult-x.org/?ref=education",
    ]
    clean = [
        "https://a.example.org/download?ref=x", "http://a.org/?utm_source=ads&utm_medium=affiliate&utm_campaign=deals", "http://adult-education.gov/", "http://spam-filter.org/docs", "http://a.org/malware-analysis", "http://a.org/phishing-awareness",
        "https://en.a.org/wiki/Spam_(food)", "http://a.org/x1casino2", "http://xn--99999999999.org/", "http://xn--bcher-kva.example/", "http://a.org/poker", "http://a.org/sex-education", "http://middlesex.org/pornic",
        "http://a.org/free-download-cheap", "http://a.org/cheap/cheap/pill", "http://a.org/%zz%", "http://a.org/" + "x/" * 100_000,
    ]
    twice = [(1, u, True, "a") for u in blocked] + [(2, u, False, "b") for u in clean] * 2
    pages = spark.createDataFrame(twice, "page_id long, url string, bad boolean, SOFT_weight string")
    rows = url_filter.judge_urls(pages).collect()
    assert len(rows) == len(twice) and [r.url for r in rows if (r.verdict == "block") != r.bad] == []
    assert all(w < url_filter.SOFT_LIMIT for w in url_filter.SOFT.values()) and len(url_filter.SOFT) == sum(len(t.split()) for t in url_filter.SOFT_BY_WEIGHT.values())


# --- tokens -----------------------------------------------------------------


def test_vocabularies_cut_otherwise_are_refused(documents, tmp_path):
    with pytest.raises(ValueError, match="normalizer"):
        token_count.count_tokens(documents, path=token_count.default_vocabulary().replace("byte_bpe_50k", "word_bpe_49k"))
    cut = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = {"normalizer": None, "pre_tokenizer": cut, "model": {"type": "BPE"}, "added_tokens": []}
    token_count.refuse_other_kinds(plain)
    for other in ({"pre_tokenizer": cut | {"add_prefix_space": True}}, {"pre_tokenizer": None}, {"model": {"type": "WordPiece"}}, {"model": {"type": "BPE", "end_of_word_suffix": "</w>"}}, {"added_tokens": [{"content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError):
            token_count.refuse_other_kinds(plain | other)


def test_token_counts_equal_the_library(spark, documents, odd_documents, clashing):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(token_count.default_vocabulary())
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n'stl1.é日😀\t<|>") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["a" * 5000, "aaa aaaa" * 500, "x<|endoftext|><|endoftext|>", " " * 4001 + "x", "".join(map(chr, range(0x20, 0x3000)))]
    count = token_count.Counter(token_count.default_vocabulary())
    assert count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    for table in (documents, odd_documents, clashing):
        for r in token_count.count_tokens(table).collect():
            n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 512, len((r.text or "").encode()))


# --- personal data ----------------------------------------------------------


def brute_spans(text):
    """The contract's patterns as they stand."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_base_spans_equal_the_patterns(documents):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab@.1234 -+()") for _ in range(rng.randint(0, 120))) for _ in range(20_000)] + [r.text for r in documents.collect()]
    for text in texts:
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_of_long_runs():
    for text in ("a" * 300_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "." * 300_000):
        pii.base_spans(text)
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.1.1.1") == [("ip", 0, 5006)] and pii.base_spans(f"{zeros}255.0.00.{zeros}7") == [("ip", 0, 10_010)]
    assert pii.base_spans(f"{zeros}256.1.1.1 9{zeros}.1.1.1") == []


def plain_words(text, spans):
    taken = {k for _, b, e in spans for k in range(b, e)}
    return [m.span() for m in pii._WORD.finditer(text) if taken.isdisjoint(range(*m.span()))]


def plain_terms(text, words):
    out = {text[b:e].lower() for b, e in words}
    return out | {text[b:f].lower() for (b, e), (c, f) in zip(words, words[1:], strict=False) if text[e:c] in ("", " ")}


def plain_disclosing(texts):
    """Terms with P(entity | term) >= 1/2 in three different contexts or more, as they are defined."""
    rows = []
    for text in texts:
        spans = brute_spans(text)
        words = plain_words(text, spans)
        near = []
        for kind, b, e in spans:
            before, after = [w for w in words if w[1] <= b][-6:], [w for w in words if w[0] >= e][:6]
            near.append(((kind, text[b:e].lower()), tuple(text[x:y].lower() for x, y in before + after), plain_terms(text, before) | plain_terms(text, after)))
        rows.append((plain_terms(text, words), near))
    found = {}
    for entity in {e for _, near in rows for e, *_ in near}:
        met = {}
        for _, near in rows:
            for e, context, terms in near:
                if e == entity:
                    for t in terms:
                        met.setdefault(t, set()).add(context)
        for t, contexts in met.items():
            both = sum(any(e == entity and t in terms for e, _, terms in near) for _, near in rows)
            p = both / sum(t in own for own, _ in rows)
            if len(contexts) >= 3 and p >= 0.5:
                found.setdefault(entity, {})[t] = p
    out = {}
    for (kind, _), terms in found.items():
        for t, p in terms.items():
            parts = t.split(" ") if " " in t else (list(t) if len(t) == 2 and ord(t[0]) > 0x3000 else [])
            if not any(x in terms for x in parts):
                out[t] = max(out.get(t, (0, "")), (p, kind))
    return out


def test_disclosing_terms_equal_their_definition(spark):
    rng = random.Random(8)
    people = {"Ann Lee": "ann@mail.example.com", "kim": "+44 20 7946 0958", "x77-k": "10.0.0.9", "李明": "li@mail.example.org", "Bob Ray": "10.1.1.1"}
    filler = "the old town by sea has many ships and few roads to go far north".split()
    texts = []
    for i in range(300):
        own = [rng.choice(filler) for _ in range(rng.randint(0, 14))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            name = rng.choice(list(people))
            own.insert(rng.randint(0, len(own)), rng.choice([name, people[name], f"{name} {people[name]}", f"{people[name]} of {name}"]))
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [None, ""])], "doc_id long, text string").repartition(3)
    want = plain_disclosing(texts)
    assert {"kim", "x77-k", "ann lee" if "ann" not in want else "ann"} & set(want) and len(want) > 3
    for most in (500_000, 1):
        got = {r.term: (r.probability, r.kind) for r in pii.disclosing_terms(docs, most_terms=most).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[t][0] - want[t][0]) < 1e-9 for t in want)


def test_terms_that_give_a_value_away(spark, odd_documents, no_documents, clashing):
    names = ["alpha", "bravo", "delta", "gamma", "omega", "sigma"]
    rows = [(i, f"{names[i % 6]} said zanzibar wrote from bob@mail.example.com {names[(i + 1) % 6]} today {names[i // 6]}") for i in range(18)]
    # the pairs of words around the address are common ones elsewhere
    rows += [(100 + i, f"{names[i % 6]} today {names[i // 6 % 6]} said and wrote from home") for i in range(600)]
    rows.append((1000, "then zanzibar left"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.term for r in pii.disclosing_terms(docs).collect()] == ["zanzibar"]
    for most in (500_000, 0):
        got = {r.doc_id: r for r in pii.find_personal_data(docs, most_terms=most).collect()}
        assert len(got) == len(rows)
        assert got[1000].spans == "term:5:13" and got[1000].n_email == 0 and got[1000].sanitised_text == "then  left"
        assert got[0].spans.startswith("email:") and "bob@" not in got[0].sanitised_text and got[130].spans == ""
    for table in (odd_documents, clashing):
        for r in pii.find_personal_data(table).collect():
            # the plain patterns take too long on runs of hundreds of thousands, which hold neither @ nor digits
            text = r.text or ""
            assert r.spans == (pii.joined(brute_spans(text)) if re.search("[@0-9]", text) else "")
    assert pii.find_personal_data(no_documents).count() == 0


def test_query_finds_terms_by_the_method(spark, tmp_path):
    from marketloom.llm.queries import QUERIES

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [f"{word()} {word()} Ann Lee {word()} +44 20 7946 095{rng.choice('8')} {word()} {word()}" for _ in range(12)] + [" ".join(word() for _ in range(30)) for _ in range(50)]
    texts.append(f"{word()} asked Ann Lee about it")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op7_personal_data"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) and rows[62].n_term >= 1 and "Ann" not in rows[62].sanitised_text
    for i, text in enumerate(texts):
        base = [x for x in rows[i].spans.split(",") if not x.startswith("term")]
        assert ",".join(x for x in base if x) == pii.joined(brute_spans(text))
        assert rows[i].base_sha256 == __import__("hashlib").sha256(pii.joined(brute_spans(text)).encode()).hexdigest()


# --- quality ----------------------------------------------------------------


def test_isotonic_fit_is_the_best_monotone_one():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 9)
        x, y, w = np.arange(n) * 1.0, rng.integers(0, 4, n) / 3, rng.integers(1, 4, n) * 1.0
        centres, levels = quality.isotonic(x, y, w)
        assert (np.diff(levels) > 0).all() or len(levels) == 1
        # the minimax formula for monotone least squares
        best = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert sorted(set(np.round(best, 9))) == pytest.approx(sorted(set(np.round(levels, 9))))


def test_partition_sums_equal_one_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "stats array<double>, label double")
    model = quality.fit(rows.repartition(7))
    z = model.features(x)
    direct = np.linalg.solve(z.T @ z / 400 + quality.RIDGE * np.eye(z.shape[1]) / quality.FEATURES, z.T @ y / 400)
    assert model.weights == pytest.approx(direct, abs=1e-6)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.classify(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter("quality IS NOT NULL")
    held = got.filter("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95
    assert held.score.between(0, 1).all()


def test_quality_of_odd_documents(spark, odd_documents, no_documents, clashing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (7, 0), (7, 0)], "doc_id long, quality int")
    model = quality.train(odd_documents, labels)
    for table in (odd_documents, clashing):
        rows = quality.classify(table, model).collect()
        assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    empty = quality.train(no_documents, labels)
    assert all(r.score == pytest.approx(0.5, abs=0.01) for r in quality.classify(odd_documents, empty).collect())
    assert quality.classify(no_documents, model).count() == 0


# --- benchmark items --------------------------------------------------------


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, 40))) for a in (1, 0))
        assert decontam.edit_distance_within(p, t)[0] == plain_distance(p, t)


def cut(text, size):
    """The first words of a text that fit a number of bytes."""
    out = ""
    for word in decontam.normalise(text).split():
        if len(f"{out} {word}".encode()) > size:
            break
        out = f"{out} {word}".strip()
    return out


def test_items_are_found_and_nothing_else(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: decontam.normalise(r.text) for r in bench.collect()}
    docs = {r.doc_id: decontam.normalise(r.text) for r in documents.collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.contaminated(documents, bench).collect()}
    # every pair, by the edit distance itself; long texts by what they have exactly
    want = {(d, i): e for d, t in docs.items() if len(t) < 3000 for i, b in items.items() if (e := decontam.edit_distance_within(b, t)[0]) <= 0.2 * len(b)}
    assert {k: e for k, e in got.items() if len(docs[k[0]]) < 3000} == want
    exact = {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}
    assert exact and exact <= got.keys() and all(got[k] == 0 for k in exact)
    kept = decontam.drop_contaminated(documents, bench)
    assert {r.doc_id for r in kept.collect()} == docs.keys() - {d for d, _ in got}


@pytest.mark.parametrize("size", [31, 60, 120, 400])
def test_edited_items_of_any_length_equal_brute_force(spark, documents, sf_dir, size):
    """Copies with 5 to 20 % of their characters edited, and all other pairs of texts and items."""
    rng = np.random.default_rng(size)
    words = " ".join(decontam.normalise(r.text) for r in documents.limit(40).collect()).split()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(60).collect()]
    items = [(i, t) for i, x in enumerate(texts) if len((t := cut(x, size)).encode()) >= 16]
    rows = []
    for share in (0.05, 0.1, 0.15, 0.2):
        for i, text in items:
            around = rng.choice(words, 30).tolist()
            rows.append((len(rows), " ".join([*around[:18], decontam._edited(text, int(share * len(text)), rng), *around[18:]])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench).collect()}
    want = {(d, i): e for d, t in rows for i, b in items if (e := decontam.edit_distance_within(b, t)[0]) <= 0.2 * len(b)}
    assert len(want) >= len(rows) and got.keys() <= want.keys()
    assert len(got) >= 0.98 * len(want)
    # the place of a long repeated item may be missed, so that another one counts
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)


@pytest.mark.parametrize("size", [31, 60, 400])
def test_evenly_edited_items_are_found(spark, sf_dir, size):
    rng = np.random.default_rng(size)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items = [(i, t) for i, x in enumerate(texts) if len((t := cut(x, size)).encode()) >= 16]
    index = decontam.build_index(items)
    for kind in (0, 1, 2):
        # copies within the limit, by the edit distance itself
        copies = [(i, e) for i, t in items * (-(-150 // len(items))) if decontam.edit_distance_within(t, e := decontam._edited(t, int(0.19 * len(t)), rng, kind))[0] <= 0.2 * len(t)]
        got = {(k, item) for k, item, *_ in decontam.find_items([e for _, e in copies], index)}
        assert sum((k, i) in got for k, (i, _) in enumerate(copies)) >= 0.92 * len(copies)


def test_screen_holds_nothing_back():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefgh "), 4000))
    buffer, _ = decontam._joined([text])
    item = text[1000:1200]
    index = decontam.build_index([(1, item)])
    edits = decontam._edited(item, 40, rng)
    spoilt, _ = decontam._joined([text[:1000] + edits + text[1200:]])
    near = lambda b, at, offset: bool(decontam._near(b, np.array([at]), index, np.array([0]), np.array([offset]))[0])
    assert near(buffer, 1000, 0) and near(buffer, 1190, 190) and near(spoilt, 1000, 0)
    assert sum(near(buffer, at, 0) for at in range(100, 900, 50)) <= 2


def test_unspaced_scripts_signs_and_repeats(spark):
    items = [
        (1, "日本語の文章は単語の間に空白を置かないので、どの文字からでも窓が始まる。"), (2, "x=[i for i in range(10)];print(sum(x))"),
        (3, "the committee (chaired by the mayor) approved the plan to rebuild the old bridge"), (3, "an entirely different question about rivers and their sources in spring"),
    ]
    rows = [
        (1, "これは前置きです日本語の文章は単語の間に空白を置かないので、どの文字からも窓が始まる。そして続く"), (2, "foo(){x=[i for i in range(10)];print(sum(x))}"),
        (3, "yes:the committee (chaired by a mayor) approved the plan to rebuild the old bridge"), (3, "yes:the committee (chaired by a mayor) approved the plan to rebuild the old bridge"),
        (4, "nothing of the kind is asked here, and it goes on for a while without an item"),
    ]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (3, 3)]
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [4]


def test_texts_of_one_repeated_word_stay_linear():
    index = decontam.build_index([(1, "word " * 60), (2, "alpha beta " * 30)])
    assert {(n, i) for n, i, *_ in decontam.find_items(["word " * 4000, "beta alpha " * 2000, "x"], index)} == {(0, 1), (1, 2)}


def test_recall_that_cannot_be_reached_is_an_error():
    with pytest.raises(ValueError, match="recall"):
        decontam.build_index([(i, f"{i} a short question about number {i * 7}") for i in range(50)], classes=((16, 40, 20),), most_edits=0.4)


def test_blocks_of_items_and_odd_rows(spark, odd_documents, no_documents, clashing):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away"), (2, "Lost"), (3, None), (4, ""), (None, "the quick brown fox jumps over the lazy dog and runs off")], "item_id long, text string")
    for most in (1 << 20, 20):
        got = {(r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(clashing, bench, most_bytes=most).collect()}
        assert got == {(12, 1, 0), (12, None, 3), (None, 2, 0)}
        assert decontam.drop_contaminated(odd_documents, bench, most_bytes=most).count() == 12
    assert decontam.contaminated(no_documents, bench).count() == 0
    assert decontam.contaminated(odd_documents, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(odd_documents, bench.limit(0)).count() == 14
