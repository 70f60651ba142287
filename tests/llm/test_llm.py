"""The training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, langid, mainhtml, maxent, media, packing, pseudonyms, simhash, suffixes, toxicity
from graphloom.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, group string, key string, token string"


def frame(spark, texts, first=0):
    rng = random.Random(1)
    rows = [(first + i, t, rng.choice(["en", "de", None]), "s", "g", "k", "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(n, seed, vocab=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocab)}x" for _ in range(n))


EDGE = [None, "", " ", "one", "word " * 3000, "same text here", "same text here", "ünï cödé   \U0001f600 x", "\n\t"]


# HTML


def test_main_text_leaves_out_what_is_not_the_article():
    page = (
        "<html><head><title>T</title><script>var a='</p><article>no</article>';</script></head><body><header>Site</header><nav><a href=x>Home</a></nav>"
        "<div class='sidebar-left'>Side</div><div class='post-12'><h1>He&amp;ad</h1><p>One <b>bo</b>ld\n  word.<p>Two&nbsp;x<br>y<div class='ad'>Buy</div><form>f<input></form>"
        "<section id='comments'><p>Reader says a lot of things in many words here and there</p></section></div><footer>F</footer></body></html>"
    )
    assert mainhtml.main_text(page, [])[0] == "He&ad One bold word. Two x y"
    assert mainhtml.main_text(None, []) == ("", "") and mainhtml.main_text("", []) == ("", "")
    assert mainhtml.main_text("a < b", [])[0] == "a < b"
    assert mainhtml.step_of("div", "post-12 b") == "div.b.post-#"


ARTICLE = "An article of some words that stands in a page."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content" style="overflow:hidden">{ARTICLE}</div>',
        f'<div class="content" title="a hidden gem">{ARTICLE}</div>',
        f'<div data-id="comment-3">{ARTICLE}</div>',
        f'<div class="content has-sidebar no-comments">{ARTICLE}</div>',
        f'<div class="content"><p class="promo">Buy<p>{ARTICLE}</div>',
        f"<div><ul><li class='ad'>Buy<li>{ARTICLE}</ul></div>",
        f"<div><math><mi>{ARTICLE}</mi></math></div>",
        f"<table><tr><td class=sidebar>Side<td>{ARTICLE}</table>",
        f"<div hidden>No</div><div aria-hidden=true>No</div><div>{ARTICLE}</div><div class='site-footer'>No</div>",
        f"<div><span>An article of </span>some words that stands in a page.</span></div>",
    ],
)
def test_main_text_of_odd_pages(page):
    assert mainhtml.main_text(f"<html><body>{page}</body></html>", [])[0] == ARTICLE


def test_main_text_against_a_tree_of_generated_pages():
    """The generator knows what is article; parts are nested and ends left out at random."""
    rng = random.Random(11)
    junk = ["<nav>Home</nav>", "<div class='ad-slot'>Buy</div>", "<aside>Side</aside>", "<script>if (a < b) x()</script>", "<style>p{}</style>", "<form>Mail<input></form>", "<div role=navigation>Menu</div>", "<ul class=menu><li>One<li>Two</ul>", "<!-- <p>note</p> -->"]
    for n in range(200):
        blocks, out = [], []
        for k in range(rng.randrange(4, 12)):
            own = " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(8, 30)))
            out.append(own.replace("w7", "w&7"))
            body = out[-1].replace("&", "&amp;").replace(" ", rng.choice([" ", "\n  ", "&nbsp;"]), 1)
            blocks.append(rng.choice([f"<p>{body}</p>", f"<p>{body}", f"<h2>{body}</h2>", f"<ul><li>{body}</ul>", f"<div>{body}</div>", f"<blockquote>{body}</blockquote>", f"<p><b>{body}</b></p>"]))
            if rng.random() < 0.3:
                blocks.append(rng.choice(junk))
        page = f"<html><head><title>t</title></head><body class=has-menu><header>Site</header>{rng.choice(junk)}<article class='post'>{''.join(blocks)}</article><footer>Foot</footer></body></html>"
        assert mainhtml.main_text(page, [])[0] == " ".join(out), page


def test_hosts_vote_on_paths(spark):
    good = "<body><div class='c-{0}'><p>" + "words of the article " * 20 + "</p></div><div class='x'><p>short</p></div></body>"
    odd = "<body><div class='c-9'><p>tiny</p></div><div class='x'><p>" + "longer but not chosen by the host " * 3 + "</p></div></body>"
    rows = [(i, "http://h.example/a", good.format(i)) for i in range(5)] + [(9, "http://h.example/b", odd), (10, None, None), (11, "::", "")]
    out = {r["page_id"]: r["text"] for r in mainhtml.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == 8 and out[9] == "tiny" and out[10] == "" and out[11] == ""
    salted = mainhtml.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_hosts=0)
    assert {r["page_id"]: r["text"] for r in salted.collect()} == out


# Language, toxicity


def test_language_backs_off_to_grams(spark):
    en = ["the cat and the dog walking", "the house and garden walking talking"] * 5
    de = ["der hund und die katze gehung", "das haus und der garten wohnung meinung"] * 5
    rows = [(i, t, "en") for i, t in enumerate(en)] + [(100 + i, t, "de") for i, t in enumerate(de)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = [(r["lang_pred"], r["score"]) for r in langid.predict(frame(spark, ["the dog", "jumping barking", "zeitung", None, "", "12 .", "ъ"]), model).orderBy("doc_id").collect()]
    assert [x[0] for x in got[:3]] == ["en", "en", "de"] and [x[0] for x in got[3:6]] == ["und"] * 3
    assert got[6][0] in ("en", "de") and all(0 <= s <= 1 for _, s in got)
    empty = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.predict(frame(spark, ["x"]), empty).first()["lang_pred"] == "und"
    assert langid.predict(frame(spark, []), model).count() == 0


def test_language_votes_against_plain_counts(spark):
    rng = random.Random(9)
    texts = {lang: [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(30)) for _ in range(12)] for lang, letters in (("en", "abcde"), ("de", "cdefg"), ("fr", "efgha"))}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs = sorted(texts)
    counts = [{lang: Counter(g for t in own for w in t.split() for g in ([w] if n == 0 else langid.grams(w, n))) for lang, own in texts.items()} for n in range(6)]
    sizes = [len(set().union(*c.values())) for c in counts]
    total = [{lang: sum(c.values()) for lang, c in by.items()} for by in counts]

    def vote(n, g):
        return [math.log((counts[n][k][g] + 0.5) / (total[n][k] + 0.5 * sizes[n])) for k in langs]

    def plain(text):
        logits, known = [0.0] * len(langs), 0
        for w in text.split():
            for n in range(6):
                n = 0 if n == 0 else 6 - n
                entries = [g for g in ([w] if n == 0 else langid.grams(w, n)) if any(c[g] for c in counts[n].values())]
                if entries:
                    known += 1
                    for k in range(len(langs)):
                        logits[k] += sum(vote(n, g)[k] for g in entries) / len(entries)
                    break
        z = [x / math.sqrt(max(known, 1)) for x in logits]
        return langs[max(range(len(langs)), key=lambda k: z[k])], 1 / sum(math.exp(x - max(z)) for x in z)

    tests = [texts["en"][0], "abab cdcd", "ghgh eeee aaa", "gfgfgf cccc", "zz abcde zz"]
    got = langid.predict(frame(spark, tests), model).orderBy("doc_id").collect()
    for t, r in zip(tests, got):
        lang, score = plain(t)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, rel=1e-4)


def test_toxicity_learns_a_pair_that_singles_do_not_show():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, 400), rng.integers(0, 2, 400)
    rows = [np.flatnonzero([x, y, 1]) for x, y in zip(a, b)]
    bias, w, v = toxicity.fit(rows, (a ^ b).astype(float), 3, rank=4, epochs=600)
    m = toxicity.Machine(8, {}, bias, w, v)
    assert all((m.logit(list(r)) > 0) == bool(x ^ y) for r, x, y in zip(rows, a, b))


def test_training_finds_pairs_that_no_single_word_shows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        own = words(20, i).split() + ["kobold"] * a + ["gremlin"] * b
        rng.shuffle(own)
        rows.append((i, " ".join(own), int(a != b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:1500]], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] > 0.5 for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert np.mean([got[i] == bool(y) for i, _, y in rows[1500:]]) > 0.95


def test_machine_against_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    m = toxicity.Machine(64, {}, 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    for ids in ([], [2], [0, 3, 4, 8]):
        want = 0.3 + sum(m.weights[i] for i in ids) + sum(float(m.factors[i] @ m.factors[j]) for i in ids for j in ids if i < j)
        assert m.logit(ids) == pytest.approx(want)


def test_toxicity_on_texts(spark):
    texts = [words(40, i) + (" horrid" if i % 4 == 0 else "") for i in range(200)] + EDGE
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(151, None), (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, texts)
    machine = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, machine).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(150, 200))
    kept = toxicity.reject(docs, machine)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 50
    none = toxicity.train(docs, labels.filter("false"))
    assert toxicity.score(docs, none).filter("score > 0.5").count() == 0
    assert toxicity.score(docs.filter("false"), machine).count() == 0 and toxicity.reject(docs.filter("false"), machine).count() == 0
    # Repeated rows and null ids keep their rows.
    odd = docs.filter("doc_id < 2").union(docs.filter("doc_id < 2")).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.col("doc_id")))
    assert toxicity.score(odd, machine).count() == 4


# Packing


def test_packing_is_gapless_and_tokens_match(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [words(n, n) for n in (1, 5, 700, 900, 3000, 40)] + EDGE + ["a <|endoftext|> b"]
    got = packing.pack_documents(frame(spark, texts), tokenizer_path(), with_ids=True).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert [x for r in own for x in r["ids"]] == ids
        assert all(r["length"] == 1024 for r in own[1:]) and all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in own)
        assert [r["start"] for r in own] == [sum(len(x["ids"]) for x in own[:k]) for k in range(len(own))]
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(frame(spark, []), tokenizer_path()).count() == 0


def test_long_runs_of_white_space_have_ids():
    from tokenizers import Tokenizer

    encode, t = packing.load_encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ("a" + " " * 2_000_000 + "b", "x" + "\n" * 30_000, " " * 19_000 + "end"):
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_against_the_definition():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 21, 300)
    where, offset = packing.sum_of_squares(lengths, 20)
    level: dict[int, int] = {}
    for s, w, o in zip(lengths, where, offset):
        cost = {}
        for b in [*level, None]:
            new = dict(level)
            new[b if b is not None else -1] = new.get(b, 0) + int(s) if b is not None else int(s)
            if new[b if b is not None else -1] <= 20:
                gaps = Counter(20 - x for x in new.values() if x < 20)
                cost[b] = sum(n * n for n in gaps.values())
        mine = w if w in level else None
        assert cost[mine] == min(cost.values()) and level.get(w, 0) == o
        level[w] = level.get(w, 0) + int(s)


# PII


def test_pseudonyms_keep_formats_and_links(spark):
    texts = ["card 4111 1111 1111 1111, 4111111111111111 and 4111111111111112", "born 1999-12-31 not 2024-02-30", "ssn 123-45-6789 000-12-3456", "ip 10.0.0.1 300.1.1.1 v2.0", "bob.smith@example.com +1 (212) 555-0100 212-555-0100", None, "", "plain words, version 3.0."]
    out = [r["text"] for r in pseudonyms.pseudonymize(frame(spark, texts), "key").orderBy("doc_id").collect()]
    spaced, joined = out[0][5:24], out[0][26:42]
    assert spaced.replace(" ", "") == joined != "4111111111111111" and out[0].endswith("4111111111111112")
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(joined))))
    assert total % 10 == 0
    assert "1999-12-31" not in out[1] and out[1].endswith("2024-02-30") and out[2].endswith("000-12-3456") and "123-45" not in out[2]
    assert "300.1.1.1 v2.0" in out[3] and "10.0.0.1 " not in out[3]
    assert "bob" not in out[4] and "@example.com" in out[4]
    a, b = out[4].split("+1 (")[1].split(" ", 2)[:2], out[4].rsplit(" ", 1)[1]
    assert a[0].strip("()") + "-" + a[1] == b != "212-555-0100"
    assert out[5] is None and out[6] == "" and out[7] == texts[7]
    other = [r["text"] for r in pseudonyms.pseudonymize(frame(spark, texts[:1]), key="other").collect()]
    assert other[0] != out[0]


def test_dates_are_permuted(spark):
    days = spark.range(0, pseudonyms.DAYS).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    forms = [(F.date_format("d", f), f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")]
    moved = {}
    for text, f in forms:
        own = days.select("d", text.alias("text")) if f != "MM/dd/yyyy" else days.filter("day(d) > 12").select("d", text.alias("text"))
        out = pseudonyms.pseudonymize(own, "key")
        # Equal dates are equal in all formats.
        moved[f] = {r[0]: r[1] for r in out.select("d", F.to_date("text", f)).collect()}
        assert len(set(moved[f].values())) == len(moved[f]) == own.count() and None not in moved[f].values()
        assert min(moved[f].values()).year == 1900 and max(moved[f].values()).year == 2099
    assert moved["yyyy-MM-dd"] == moved["dd/MM/yyyy"] and all(moved["yyyy-MM-dd"][d] == x for d, x in moved["MM/dd/yyyy"].items())


def test_feistel_against_plain_python(spark):
    def plain(digits, radices, key, tag):
        cut = len(digits) // 2
        left, right = list(digits[:cut]), list(digits[cut:])
        for k in range(pseudonyms.ROUNDS):
            own, other, first = (left, right, 0) if k % 2 == 0 else (right, left, cut)
            text = ",".join(map(str, other))
            for i in range(len(own)):
                h = hashlib.sha256(f"{key}|{tag}|{k}|{i // 16}|{text}".encode()).hexdigest()
                own[i] = (own[i] + int(h[4 * (i % 16) : 4 * (i % 16) + 4], 16)) % radices[first + i]
        return left + right

    for digits, radices in (([4, 1, 1, 9], [10, 10, 10, 10]), ([100, 3, 7], [200, 7, 19]), (list(range(10)) * 4, [10] * 40)):
        sql = pseudonyms.feistel(f"array({','.join(map(str, digits))})", f"array({','.join(map(str, radices))})", "k", "t")
        assert list(spark.range(1).select(F.expr(sql)).first()[0]) == plain(digits, radices, "k", "t")


def test_pseudonyms_leave_other_columns(spark):
    docs = frame(spark, ["ip 10.0.0.1", None, ""]).withColumns({"_found": F.lit(1), "_put": F.lit("x")})
    out = pseudonyms.pseudonymize(docs, "key")
    assert out.columns == docs.columns and {(r["_found"], r["_put"]) for r in out.collect()} == {(1, "x")}
    assert pseudonyms.pseudonymize(docs.filter("false"), "key").count() == 0
    with pytest.raises(ValueError):
        pseudonyms.pseudonymize(docs, "")


# Decontamination


def test_decontamination_against_brute_force(spark):
    items = [words(random.Random(i).randrange(8, 40), 1000 + i) for i in range(60)] + [None, "", "tiny"]
    rng = random.Random(5)
    texts = []
    for i in range(120):
        t = words(300, i).split()
        if i % 3 == 0:
            t[rng.randrange(300) : 0] = []
            at = rng.randrange(300)
            t[at:at] = items[i % 60].split()
        if i % 5 == 0:
            t[10:10] = items[(i * 7) % 60].split()[:-2]
        texts.append(" ".join(t))
    texts += EDGE
    docs, bench = frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    expected = set()
    for d, t in enumerate(texts):
        have = decontaminate.words(t)
        runs = {tuple(have[k : k + 5]) for k in range(len(have))} | {tuple(have[k : k + n]) for n in range(1, 5) for k in range(len(have))}
        for i, item in enumerate(items):
            w = decontaminate.words(item)
            s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            if s and len(s & runs) >= 0.8 * len(s):
                expected.add((d, i))
    assert got == expected and got
    sharded = decontaminate.contaminated(docs, bench, shard_items=20)
    values = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    whole = {(r[0], r[1]): r[2:] for r in decontaminate.contaminated(docs, bench).select(values).collect()}
    parts = {(r[0], r[1]): r[2:] for r in sharded.select(values).collect()}
    assert whole.keys() == parts.keys() and all(parts[k] == pytest.approx(v) for k, v in whole.items())
    dirty = {d for d, _ in got}
    for few in (20_000, 20):
        odd = docs.withColumns({"_gone": F.lit(7), "doc_id": F.when(F.col("doc_id") >= 9, F.col("doc_id"))})
        kept = decontaminate.clean(odd, bench, shard_items=few)
        assert kept.columns == odd.columns and kept.count() == len(texts) - len(dirty)
    assert decontaminate.clean(docs, bench.filter("false")).count() == len(texts)
    assert decontaminate.clean(docs.filter("false"), bench).count() == 0
    # A null id is an id.
    assert decontaminate.contaminated(docs.withColumn("doc_id", F.lit(None).cast("long")), bench).count() == len({i for _, i in got})
    assert decontaminate.contaminated(docs, bench.filter("false")).count() == 0


def test_retrieval_against_scoring_every_item():
    rng = random.Random(6)
    items = [(i, words(rng.randrange(4, 30), 50 + i, 60)) for i in range(40)]
    index = decontaminate.build_index(items, 0.5)
    number = decontaminate._Words(index.vocabulary)
    texts = [words(rng.randrange(1, 90), 500 + i, 80) + " " + items[i][1] for i in range(40)]
    ids = [np.array([number[t] for t in x.split()]) for x in texts]
    got = {(d, i, round(s, 9)) for d, i, s, *_ in decontaminate.search(index, ids, 0.5, -1.0)}
    want = set()
    for d, own in enumerate(ids):
        for at in range(0, len(own), index.longest):
            passage = set(own[at : at + 2 * index.longest].tolist())
            for i in range(len(items)):
                s = sum(float(y) for x, y in zip(index.terms[i], index.shares[i]) if int(x) in passage)
                if s >= 0.5 - 1e-9:
                    want.add((d, i, round(s, 9)))
    assert got == want and len(want) >= 40


# Language model


def test_model_is_a_distribution_and_base_scores_are_exact(spark):
    texts = [words(60, i, 60) for i in range(60)] + EDGE
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in maxent.score_texts(docs).collect()}
    counts: Counter = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(maxent.tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        own = maxent.tokens_of(t)
        assert got[i]["n_tokens"] == len(own) and got[i]["n_known"] == sum(counts[w] > 0 for w in own) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert got[i]["score"] < 0
    few = maxent.score_texts(docs, heavy=3)
    assert {r["doc_id"]: r["n_known"] for r in few.collect()} == {i: r["n_known"] for i, r in got.items()}
    # Over all words after one context, and one unknown word a shared slot.
    _, vocabulary, w = maxent.fit(docs)
    codes = np.array([maxent.code_of(t, vocabulary.own, vocabulary.class_of_unit) for t in counts])
    total = 0.0
    for code, token in zip(codes, counts):
        p = maxent.score_codes(w, np.array([7, code]), np.array([True, False]))[1]
        place = code % maxent.PLACES
        shared = place % maxent.SLOTS >= maxent.OWN
        total += 10 ** (p + (vocabulary.base(counts[token]) - vocabulary.base(0) - vocabulary.mass[place] if shared else 0))
    assert 0 < total <= 1 + 1e-5
    assert maxent.score_texts(frame(spark, [])).count() == 0
    # Repeated rows and null ids keep their rows and scores.
    twice = docs.filter("doc_id < 3").union(docs.filter("doc_id < 3")).union(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    again = maxent.score(twice, *maxent.fit(docs)).collect()
    assert sorted(str(r["doc_id"]) for r in again) == ["0", "0", "1", "1", "2", "2", "None"]
    assert all(r["n_tokens"] == len(maxent.tokens_of(texts[5 if r["doc_id"] is None else r["doc_id"]])) for r in again)


def test_scores_against_a_plain_softmax():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, maxent.PLACES, 60) + maxent.PLACES * rng.integers(0, 50, 60)
    starts = np.zeros(60, bool)
    starts[[0, 1, 20]] = True
    w = maxent.Weights(rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32), rng.normal(size=(maxent.IN_ROWS, maxent.SLOTS)).astype(np.float32))
    got = maxent.score_codes(w, codes, starts)
    mix = lambda x, size: (((int(x) + 1) * 0x9E3779B97F4A7C15) % 2**64) >> (65 - size.bit_length())
    for i, code in enumerate(codes.tolist()):
        at = max(j for j in range(i + 1) if starts[j])
        one = int(codes[i - 1]) if i - 1 >= at else maxent.START
        two = int(codes[i - 2]) if i - 2 >= at else maxent.START
        kind = lambda c: maxent.CLASSES if c == maxent.START else c % maxent.PLACES // maxent.SLOTS
        k, slot = kind(code), code % maxent.SLOTS
        h = mix(one, maxent.ONE)
        z = w.outer[[h, maxent.ONE + mix(two, maxent.TWO), maxent.ONE + maxent.TWO + mix(one * 1_000_003 + two, maxent.BOTH), maxent.ONE + maxent.TWO + maxent.BOTH + kind(one) * (maxent.CLASSES + 1) + kind(two), -1]].astype(float).sum(axis=0)
        y = w.inner[[k * maxent.IN_CLASS + h % maxent.IN_ONE, k * maxent.IN_CLASS + maxent.IN_ONE + kind(one), (k + 1) * maxent.IN_CLASS - 1]].astype(float).sum(axis=0)
        want = z[k] - math.log(np.exp(z).sum()) + y[slot] - math.log(np.exp(y).sum())
        assert got[i] == pytest.approx(want / math.log(10), abs=1e-4)


def test_a_thousand_tokens_train_every_feature_group():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 20 * maxent.PLACES, 1000)
    starts = np.zeros(len(codes), bool)
    starts[::50] = True
    w = maxent.Weights.initial(np.ones(maxent.PLACES))
    old = maxent.Weights(w.outer.copy(), w.inner.copy())
    state = {"outer": np.full_like(w.outer, 1.0), "inner": np.full_like(w.inner, 1.0), "outer_used": np.zeros(maxent.ROWS, np.int64), "inner_used": np.zeros(maxent.IN_ROWS, np.int64)}
    before = maxent.score_codes(w, codes, starts).sum()
    maxent.learn(w, codes, starts, state)
    edges = np.cumsum([0, maxent.ONE, maxent.TWO, maxent.BOTH, maxent.PAIR, 1])
    for a, b in zip(edges, edges[1:]):
        assert state["outer_used"][a:b].sum() == len(codes) and np.abs(w.outer[a:b] - old.outer[a:b]).sum() > 0
    of_class = np.arange(maxent.IN_ROWS) % maxent.IN_CLASS
    for rows in (of_class < maxent.IN_ONE, (of_class >= maxent.IN_ONE) & (of_class < maxent.IN_CLASS - 1), of_class == maxent.IN_CLASS - 1):
        assert state["inner_used"][rows].sum() == len(codes) and np.abs(w.inner[rows] - old.inner[rows]).sum() > 0
    assert maxent.score_codes(w, codes, starts).sum() > before


# Suffixes


def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    first: dict[bytes, int] = {}
    for i, b in enumerate(raw):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(2)
    passages = [words(rng.randrange(8, 30), 50 + k) for k in range(8)] + ["ab" * 60, "a" * 130]
    texts = []
    for i in range(90):
        t = words(rng.randrange(5, 80), i)
        for _ in range(rng.randrange(3)):
            t += " " + rng.choice(passages) + " " + words(4, 900 + i)
        texts.append(t)
    texts += [texts[3], texts[4][:-1]] + EDGE
    got = [tuple(r)[1:] for r in suffixes.dedup(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == brute_removed(texts)
    assert suffixes.dedup(frame(spark, [])).count() == 0


def test_deep_shallow_sort_finds_equal_windows():
    rng = np.random.default_rng(1)
    buf = np.concatenate([rng.integers(97, 99, 3000).astype(np.uint8), np.zeros(64, np.uint8)])
    starts = np.concatenate([np.arange(0, 2900, 3), np.arange(0, 900, 2)])
    order = rng.integers(0, 50, len(starts))
    least: dict[bytes, int] = {}
    for s, o in zip(starts, order):
        k = buf[s : s + 50].tobytes()
        least[k] = min(o, least.get(k, 99))
    assert suffixes.earlier_copies(buf, starts, order).tolist() == [o > least[buf[s : s + 50].tobytes()] for s, o in zip(starts, order)]


# SimHash


def test_simhash_components_against_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = list(dict.fromkeys(b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(12)))
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for limit in (4096, 3):
        found = {r["name"]: r["component"] for r in simhash.components(simhash.edges(reps, 3, limit)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == [root(i) for i in range(len(fps))]


def test_near_duplicates_and_edges(spark):
    t = words(200, 1)
    texts = [t, t + " end", t, *EDGE, words(200, 2)]
    got = [r["component_id"] for r in simhash.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == got[2] == 0 and got[3] == got[4] == 3 and len(got) == len(texts)
    edited = t.split()
    edited[100] = "changed"
    docs = frame(spark, [t, " ".join(edited), words(200, 3), t, None])
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 2, 4]
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0
    # Links that run over a text without id, and a group without any.
    bits = lambda f: f - (1 << 64) if f >> 63 else f
    base = simhash.fingerprint(t)
    assert bits(base) == simhash.near_duplicates(frame(spark, [t])).first()["fp"]
    nameless = docs.withColumns({"_gone": F.lit(1), "doc_id": F.when(F.col("doc_id") != 2, F.col("doc_id"))})
    kept = simhash.keep_one(nameless)
    assert kept.columns == nameless.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "4", "None"]
    alone = simhash.near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(alone) == 5 and all(r["component_id"] is None for r in alone)


@pytest.mark.parametrize("text", EDGE)
def test_fingerprint_against_the_definition(text):
    import xxhash

    own = (text or "").encode().lower().split()
    runs = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_links_over_a_text_without_id(spark):
    """Three fingerprints in a row, the middle one without id."""
    rows = [(5, 0), (None, 0b111), (9, 0b111111), (None, 1 << 40)]
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    before = simhash.fingerprints
    simhash.fingerprints = lambda *a: fps
    try:
        got = {r["fp"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, [])).collect()}
    finally:
        simhash.fingerprints = before
    assert got == {0: 5, 0b111: 5, 0b111111: 5, 1 << 40: 5}


def test_shingles_and_bounds():
    for text in EDGE:
        own = (text or "").lower().split()
        runs = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
        assert len(simhash.shingle_set(text, 5)) == len(runs)
    a, b = simhash.shingle_set(words(300, 1), 5), simhash.shingle_set(words(300, 1) + " " + words(20, 2), 5)
    assert simhash.overlap(a, b) == len(set(a.tolist()) & set(b.tolist()))
    differ = int(np.bitwise_count(simhash.bitmap(a) ^ simhash.bitmap(b)).sum())
    assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_keep_one_against_all_pairs(spark):
    rng = random.Random(7)
    texts = []
    for g in range(6):
        base = [f"word{g}x{i}" for i in range(60)]
        for _ in range(3):  # the same words in another order: one fingerprint, low Jaccard
            order = rng.sample(base, len(base))
            texts.append(" ".join(order))
            for k in (20, 40):
                texts.append(" ".join([*order[:k], "a", *order[k:]]))
            texts.append(" ".join(["other" + str(g), *order[1:]]))
    rng.shuffle(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = [simhash.word_fingerprints(np.unique(simhash.word_hashes(t)), 3) for t in texts]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if any((x ^ y).bit_count() <= 5 for x, y in zip(fps[i], fps[j])) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    want = [i for i in range(len(texts)) if root(i) == i]
    assert sorted(r["doc_id"] for r in simhash.keep_one(frame(spark, texts)).collect()) == want


def test_same_words_in_other_orders_make_no_rows_for_pairs(spark, monkeypatch):
    """One fingerprint, no similar pair: what is written grows with the texts, not with their pairs."""
    rng = random.Random(9)
    base = [f"word{i}" for i in range(90)]
    texts = [" ".join(rng.sample(base, len(base))) for _ in range(120)]
    counts, write = {}, simhash.materialize

    def counted(df, name):
        out = write(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    assert simhash.keep_one(frame(spark, texts)).count() == len(texts)
    assert max(counts.values()) <= 64 * len(texts), counts


@pytest.mark.parametrize("run_limit", [4096, 9])
def test_pairs_apart_against_all_pairs(spark, run_limit):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = [base[i % 4] ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(6))) for i in range(160)]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    n = [rng.randrange(0, 3) * 20 + 40 for _ in fps]
    bitmaps = [[signed(sum(1 << p for p in rng.sample(range(64), rng.randrange(3)))) for _ in range(simhash.LONGS)] for _ in fps]
    comp = [i if rng.random() < 0.7 else i % 4 for i in range(len(fps))]
    texts = spark.createDataFrame([(k, signed(f), i, n[i], comp[i]) for k in (0, 1) for i, f in enumerate(fps)], "k int, fp long, id long, n long, comp long")
    sketch = spark.createDataFrame([(i, *b) for i, b in enumerate(bitmaps)], "id long, " + ", ".join(f"m{k} long" for k in range(simhash.LONGS)))
    want = set()
    for i in range(len(fps)):
        for j in range(i):
            differ = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(bitmaps[i], bitmaps[j]))
            most = (n[i] + n[j]) / 9 + 1e-6
            if comp[i] != comp[j] and (fps[i] ^ fps[j]).bit_count() <= 5 and differ <= most and abs(n[i] - n[j]) <= most:
                want.add((i, j))
    got = [(r["a"], r["b"]) for r in simhash.pairs_apart(texts, sketch, 0.8, 5, run_limit).collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


# Media


def test_media_round_trip(spark, tmp_path):
    texts = [*EDGE, "x" * 64, "y" * 65]
    docs = frame(spark, texts)
    root = f"file://{tmp_path}/media"
    rows = media.media_columns(docs, root=root).orderBy("doc_id").collect()
    stored = {}
    for f in (tmp_path / "media").glob("*.tar"):
        stored |= media.tar_members(f.read_bytes())
    for r, t in zip(rows, texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["height"] * 64 == len(payload)
        png = stored[r["digest"] + ".png"]
        assert media.png_decode(png) == payload and len(png) == r["media_bytes"] and hashlib.sha256(png).hexdigest() == r["media_sha256"]
    assert rows[5]["feature"] == rows[6]["feature"]


# Pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    clean = [words(80, i) for i in range(60)]
    toxic = [words(80, 200 + i) + " horrid" for i in range(40)]
    leak = words(30, 999)
    edited = clean[0].split()
    edited[40] = "edit"
    texts = [*clean, *toxic, " ".join(edited), clean[1], words(50, 77) + " " + leak, "mail bob@example.com now " + words(40, 5)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(60 <= i < 100)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {*range(60), 103}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
