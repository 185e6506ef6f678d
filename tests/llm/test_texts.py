"""Operators on single texts: tokens, counts, classifiers, pages, shards."""

import base64
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

ODD = [None, "", " ", "  ", "a  b", " a", "a ", "\n a\t b \n", "it's 's ' s", "\x1c a\x1d", "\x85 b", "\xa0 \xa0c", "日本語 テキスト" * 40, "-" * 700, " " * 700, "x" + " " * 90 + "y", "▁▁a ▁", "１２３ ４", "ﬁ \x00", "😀😀 😀", "<s> <unk>", "don't  stop\n\nnow"]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" \n\tab'sé1.!▁　\x1c日") for _ in range(rng.randint(0, 60))) for _ in range(300)]


def frame(spark, values, **extra):
    return spark.createDataFrame(pd.DataFrame({"doc_id": range(len(values)), "text": pd.Series(values, dtype=object)} | extra))


def test_encoding_is_the_library_s(spark):
    import tiktoken

    from datagauge.llm.byte_bpe import decode_ids, encode

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    said = texts()
    df = frame(spark, said, ids=["clash"] * len(said), n_tokens=["clash"] * len(said))
    out = encode(df, path, P.PATTERN, output=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"))
    got = {r.doc_id: r for r in decode_ids(out, path, "ids", "again").collect()}
    for i, t in enumerate(said):
        want = library.encode_ordinary(t or "")
        assert got[i].ids == want and got[i].n_tokens == len(want), repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert bytes(got[i].decoded) == bytes(got[i].again) == (t or "").encode()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode(df.limit(0), path, P.PATTERN).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        decode_ids(spark.createDataFrame([([99_999],)], "ids array<int>"), path).collect()


def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("widths", [(2, 4, 6, 8, 12, 16, 32, 64, 128, 512), (3,)])
def test_chunk_memory_is_bounded(monkeypatch, widths):
    from datagauge.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "KEPT_CHUNKS", 10)
    monkeypatch.setattr(byte_bpe, "WIDTHS", widths)
    own, known = byte_bpe.Encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), library()
    for _ in range(2):  # chunks are forgotten and learned again
        for t in texts():
            ids, at = own(pa.array([t, "one two one two three"], pa.string()))
            assert ids[: at[1]].tolist() == known.encode_ordinary(t or "") and ids[at[1] :].tolist() == known.encode_ordinary("one two one two three")
            assert len(own.known) <= 40


def test_long_pieces_are_the_library_s():
    from datagauge.llm import byte_bpe

    ranks, known, rng = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), library(), random.Random(3)
    tokens = [t.tobytes() for t in np.split(ranks.bytes, ranks.starts[1:]) if len(t)]
    for n in range(1, 300, 13):
        for raw in (b"".join(rng.choice(tokens) for _ in range(n)), bytes(rng.choice(b"ab s-'") for _ in range(4 * n)), b"ab" * n, b"-" * n):
            assert ranks.merge_row(ranks.single[np.frombuffer(raw, np.uint8)]).tolist() == known._encode_single_piece(raw)


def test_loose_rows_hold_all_that_need_care():
    from datagauge.llm.byte_bpe import loose
    from datagauge.llm.kernels import buffers

    said = [*texts(), *[f"a{chr(c)}{d}b" for c in range(0x3100) for d in (" ", "") if chr(c).isspace()], *[f"a {chr(c)}b" for c in range(0x3100) if chr(c).isspace()], "plain words", "é à"]
    found = loose(*buffers(pa.array(said, pa.string())))
    for t, f in zip(said, found.tolist(), strict=True):
        assert f or not re.search(r" \s|\s |^ | $", t or "")
    assert not found[-1] and not found[-2]


def test_counts_are_the_library_s(spark):
    import sentencepiece

    from datagauge.llm.token_counts import count_tokens

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    said = [*texts(), "word " * 5000]
    got = {r.doc_id: r for r in count_tokens(frame(spark, said, n_bytes=["clash"] * len(said)), path, limit=4096).collect()}
    for i, t in enumerate(said):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(library.encode(t or "")), len((t or "").encode())), repr(t)
        assert got[i].over_limit == (got[i].n_tokens > 4096)
    assert got[len(said) - 1].over_limit


def labelled(spark, kind):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, flags = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if bad and kind == "toxic":
            w[rng.randrange(len(w))] = rng.choice(["idiot", "scum", "moron"])
        text = "$$$ ".join(w) if bad and kind == "quality" else " ".join(w) + "."
        docs.append((i, text, "en"))
        flags.append((i, int(bad) if kind == "toxic" else int(not bad)))
    docs += [(1000, None, None), (1001, "", None), (None, "x y", None), (5, docs[5][1], "en")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame([*flags, (7, None), (None, 1)], f"doc_id bigint, {kind} int"), dict(flags)


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    from datagauge.llm import quality, toxicity

    docs, labels, flags = labelled(spark, kind)
    module, threshold = (quality, 0.3) if kind == "quality" else (toxicity, 0.5)
    rows = module.classify(docs.selectExpr("*", "'clash' as score"), labels, threshold, ["doc_id"]).collect()
    assert len(rows) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in flags]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert np.mean([r.predicted == flags[r.doc_id] for r in held]) > 0.95
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    none = module.classify(docs, labels.limit(0), threshold, ["doc_id"]).collect()
    assert len(none) == 904 and len({r.score for r in none}) == 1


def test_a_toxic_pair_of_harmless_terms_is_learned():
    from datagauge.llm import toxicity
    from datagauge.llm.kernels import buffers

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]

    def said(n):
        rows = [[rng.choice(words) for _ in range(12)] + [w for w in ("insult", "group") if rng.random() < 0.5] for _ in range(n)]
        y = np.array([("insult" in r) == ("group" in r) for r in rows], float)
        return *toxicity.terms(*buffers(pa.array([" ".join(rng.sample(r, len(r))) for r in rows]))), y

    ids, at, y = said(3000)
    machine = toxicity.fitted(ids, at, y)
    ids, at, y = said(500)
    bare = toxicity.Machine(machine.bias, machine.weights, machine.factors * 0)
    assert ((machine.score(ids, at) >= 0.5) == y).mean() > 0.95
    assert ((bare.score(ids, at) >= 0.5) == y).mean() < 0.8


def test_logits_are_sums_over_pairs():
    from datagauge.llm import toxicity

    rng = np.random.default_rng(4)
    machine = toxicity.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 3)))
    sets = [rng.choice(50, n, replace=False) for n in (0, 1, 2, 7, 0, 30)]
    got = machine.logits(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for value, own in zip(got, sets, strict=True):
        pairs = sum(machine.factors[i] @ machine.factors[j] for n, i in enumerate(own) for j in own[:n])
        assert value == pytest.approx(0.3 + machine.weights[own].sum() + pairs)


def test_pairs_count_on_the_tables():
    import os

    from datagauge.llm import toxicity
    from datagauge.llm.kernels import buffers

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    rows = pd.read_parquet(f"{d}/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    ids, at = toxicity.terms(*buffers(pa.array(rows.text, pa.string())))
    y = rows.toxic.to_numpy(float)
    machine = toxicity.fitted(*toxicity.chosen(ids, at, np.flatnonzero(~held)), y[~held])
    bare = toxicity.Machine(machine.bias, machine.weights, machine.factors * 0)
    with_pairs, without = (m.score(*toxicity.chosen(ids, at, np.flatnonzero(held))) for m in (machine, bare))
    assert ((with_pairs >= 0.5) == y[held]).mean() > 0.97 and ((with_pairs >= 0.5) != (without >= 0.5)).any()
    assert np.abs(with_pairs - y[held]).mean() < np.abs(without - y[held]).mean()


def test_quality_is_ridge_on_features_of_a_gaussian_kernel(spark):
    from datagauge.llm import quality
    from datagauge.llm.kernels import buffers

    docs, labels, flags = labelled(spark, "quality")
    model = quality.fit(docs, labels, dimensions=64)
    texts_ = {r.doc_id: r.text for r in docs.collect() if r.doc_id in flags}
    rows = [i for i in sorted(texts_) if zlib.crc32(str(i).encode()) % 5 > 1]
    every = [i for i in sorted(texts_) if zlib.crc32(str(i).encode()) % 5 > 0]
    seen = [*every, *([5] if zlib.crc32(b"5") % 5 else [])]  # a repeated row counts twice
    x = quality.statistics(*buffers(pa.array([texts_[i] for i in seen])))
    assert np.allclose(model.centre, x.mean(0)) and np.allclose(model.scale[x.std(0) > 1e-6], x.std(0)[x.std(0) > 1e-6])
    own = [*rows, *([5] if zlib.crc32(b"5") % 5 > 1 else [])]
    z = model.features(quality.statistics(*buffers(pa.array([texts_[i] for i in own]))))
    y = np.array([flags[i] for i in own], float)
    penalty = 1e-2 * len(z) / z.shape[1] * np.eye(z.shape[1])
    penalty[0, 0] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    wide = quality.Model(np.zeros(3), np.ones(3), np.random.default_rng(1).normal(size=(3, 20_000)) / 2.0, np.random.default_rng(2).uniform(0, 2 * np.pi, 20_000), np.zeros(1), np.zeros(1), np.zeros(1))
    a, b = np.array([[0.1, -0.4, 0.9]]), np.array([[0.5, 0.2, 0.3]])
    assert (wide.features(a)[:, 1:] @ wide.features(b)[:, 1:].T).item() == pytest.approx(np.exp(-((a - b) ** 2).sum() / 8), abs=0.02)


def test_isotonic_is_monotone():
    from datagauge.llm.quality import isotonic

    rng = np.random.default_rng(0)
    s = rng.random(200)
    knots, values = isotonic(s, (rng.random(200) < s).astype(float))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One<br>two<p>x&nbsp; y &amp</p><script>var a="</p>";</script><aside>side</aside><div id="comments">c</div></article><footer>&copy;</footer>'
PLAIN = "<body><p>Menu one<p>Shared top<div>Story {0} begins</div><p>It ends {0}.<p>Shared low</body>"


def test_pages(spark):
    from datagauge.llm.html_text import extract

    pages = [(1, "http://a.example/x", PAGE, "clash"), (2, "http://b.example/s/1", PLAIN.format("one"), ""), (3, "http://b.example/s/2", PLAIN.format("two"), ""), (4, None, None, ""), (5, "http://c.example/", "", ""), (6, "http://d.example/", PLAIN.format("alone"), ""), (7, "http://e.example/", "<main><p>m</p></main><p>out</p><!-- x", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, text string").repartition(1)
    got = {r.page_id: r for r in extract(df).collect()}
    assert got[1].text == "A & B\n\nOne two\n\nx y &"
    assert got[2].text == "Story one begins\n\nIt ends one." and got[3].text == "Story two begins\n\nIt ends two."
    assert got[4].text == got[5].text == "" and got[6].text.startswith("Menu one") and got[7].text == "m"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert extract(df.limit(0)).count() == 0


def test_copies_of_pages_keep_their_text(spark, monkeypatch):
    from datagauge.llm import html_text

    main = "<body><p>Shared top<main><p>Story {0} begins and goes on</p><p>It ends {0} after all.</p></main><p>Shared low</body>"
    said = lambda n: f"Story {n} begins" + "\n\n" + f"It ends {n}."
    pages = [(i, f"http://b.example/s/1?v={i}", PLAIN.format("one"), said("one")) for i in range(300)]
    pages += [(300, "http://b.example/s/1/print", "<div>Story one begins</div><p>It ends one.", said("one")), *[(301 + i, "http://b.example/s/2" + "0" * i, PLAIN.format(n), said(n)) for i, n in enumerate(("two", "four"))]]
    pages += [(400 + i, f"http://c.example/{i}", main.format("three"), "Story three begins and goes on\n\nIt ends three after all.") for i in range(3)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, want string").repartition(1)
    for sent in (html_text.SENT, 50):
        monkeypatch.setattr(html_text, "SENT", sent)
        got = html_text.extract(df).collect()
        assert len(got) == len(pages) and all(r.text == r.want for r in got)


def paired_by_hand(rows, reach):
    """(page_id, text) from rows of (page_id, host, path, content, html): neighbours are looked up among all pages of the host."""
    from datagauge.llm import html_text as h

    out = {}
    for host in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == host), key=lambda r: (r[2], r[3], r[0]))
        runs = []
        for r in own:
            if runs and runs[-1][0][3] == r[3]:
                runs[-1].append(r)
            else:
                runs.append([r])
        lines = [h.lines_of(x[0][4] or "") for x in runs]
        for at, run in enumerate(runs):
            for page_id, _, path, _, _ in run:
                near = []
                for step, end in ((-1, -1), (1, 0)):
                    for to in range(at + step, at + step * (reach + 1), step):
                        if 0 <= to < len(runs) and lines[to] and not h.within(lines[at], lines[to]) and not h.within(lines[to], lines[at]):
                            near.append((h.prefix(runs[to][end][2], path), -len(near), lines[to]))
                            break
                out[page_id] = h.main_text(lines[at], max(near)[2] if near and host and lines[at] else None)
    return out


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_neighbours_do_not_depend_on_partitions(spark, parts):
    from datagauge.llm import html_text

    rng = random.Random(6)
    said = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.randint(3, 9)))
    templates, pages = [[said() for _ in range(3)] for _ in range(3)], []
    for i in range(160):
        top, menu, low = templates[rng.randrange(3)] if rng.random() < 0.3 else templates[0]
        body = "".join(f"<p>{said()}</p>" for _ in range(rng.randint(1, 4)))
        pages.append((i, f"http://{rng.choice('ab')}.example/{rng.choice('xy')}/{rng.randint(0, 30)}?n={i}", f"<body><p>{top}<p>{menu}</p>{body}<p>{low}</body>"))
        if i % 7 == 0:
            pages += [(1000 * (k + 1) + i, pages[-1][1] if k % 2 else pages[-1][1].replace("?", f"/{k}?"), pages[-1][2]) for k in range(rng.randint(1, 12))]
    pages += [(9000, None, "<p>no address"), (9001, "http://c.example/", None), (9002, "http://c.example/", "<p>alone")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "'clash' as host", "1 as target", "'own' as own", "0 as side")
    keys = {r.own.page_id: (r.host, r.path, r.content) for r in html_text.keyed(df, "html", "url", ["page_id"]).collect()}
    want = paired_by_hand([(i, *keys[i], h) for i, _, h in pages], html_text.REACH)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = html_text.extract(df.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r.page_id: r.text for r in got} == want and len(got) == len(pages)
    assert all((r.host, r.target, r.own, r.side) == ("clash", 1, "own", 0) for r in got)


@pytest.mark.parametrize("parts", [1, 5])
def test_neighbours_stand_behind_any_number_of_copies(spark, parts):
    from datagauge.llm import html_text

    rng = random.Random(8)
    said = lambda n=6: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    low, story, pages = said(), [said() for _ in range(12)], []
    page = lambda *lines: "<body>" + "".join(f"<p>{x}</p>" for x in lines)
    for i in range(90):  # one story, each time with another line: all are copies, but for the ends and one in between
        far = i in (0, 61, 89)
        pages.append((i, f"http://a.example/{i:03}", page("Menu", *([said() for _ in range(3)] if far else [*story, said(1)]), low)))
    for i in range(40):  # short pages that hold parts of a long one
        lines = [said()] if i in (0, 39) else story if i == 20 else [story[i % 12]]
        pages.append((100 + i, f"http://b.example/{i:03}", page("Menu", *lines)))
    pages += [(200 + i, f"http://c.example/{i:03}", page("Menu", *story, said(1))) for i in range(30)]  # copies only
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    keys = {r.own.page_id: (r.host, r.path, r.content) for r in html_text.keyed(df, "html", "url", ["page_id"]).collect()}
    want = paired_by_hand([(i, *keys[i], h) for i, _, h in pages], len(pages))
    assert not any(want[i].startswith("Menu") or low in want[i] for i in range(90)) and want[210].startswith("Menu")
    assert want != paired_by_hand([(i, *keys[i], h) for i, _, h in pages], html_text.REACH)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = html_text.extract(df.coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.page_id: r.text for r in got} == want and len(got) == len(pages)


def test_stretches_of_copies_are_passed_like_single_ones(monkeypatch):
    from datagauge.llm import html_text as h

    rng = random.Random(9)
    monkeypatch.setattr(h, "STRETCH", 4)
    for _ in range(60):
        common = [rng.choice("abcdefgh") * 9 for _ in range(rng.randint(0, 5))]
        made = [[(x, h.LINE) for x in rng.choice(([], common, common[:1])) + [rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(0, 2))]] for _ in range(40)]
        runs = [h.Run("host", i, lines, [(f"{i:03}", True)]) for i, lines in enumerate(made)]
        search = h.Search(runs)
        for at in range(40):
            for side in (-1, 1):
                rest = runs[at + 1 :] if side > 0 else runs[:at][::-1]
                if made[at]:
                    assert search.nearest(made[at], side, (f"{at:03}", at)) is next((r for r in rest if not h.copies(runs[at], r)), None)


def test_hints_of_wrappers_are_not_boilerplate():
    from datagauge.llm.html_text import lines_of

    said = lambda page: [s for s, _ in lines_of(page)]
    assert said("<div class=\"has-sidebar x\"><p>a</p><div class=\"post-comments\">c</div></div>") == ["a"]
    assert said("<article class=\"post-ad\"><p>t</p><article class=\"comment\">c</article></article>") == ["t"]
    assert said("<div id=\"ad\"><p>only</p></div>") == ["only"]
    assert said("<header>h</header><article><header><h1>T</h1></header>b</article>") == ["T", "b"]


def test_pages_of_the_tables(spark, sf_dir):
    from datagauge.llm.registry import op4_html_text

    got = {r.page_id: r.text for r in op4_html_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_shared_lines_are_a_longest_common_subsequence():
    from datagauge.llm.html_text import shared

    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(shared(a, b))
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(a[k] in rest for k in found)


def test_slots_are_a_permutation():
    from datagauge.llm.shards import slots

    for n in (1, 2, 3, 5, 17, 1000, 4097):
        assert sorted(slots(np.arange(n), n, "k").tolist()) == list(range(n))
    assert slots(np.arange(50), 50, "a").tolist() != slots(np.arange(50), 50, "b").tolist()


@pytest.mark.parametrize("bound", [48_000_000, 40])
def test_shards_hold_every_sequence(spark, tmp_path, monkeypatch, bound):
    import tiktoken

    from datagauge.llm import shards

    monkeypatch.setattr(shards, "PACKED", bound)
    monkeypatch.setattr(shards, "WRITERS", 3 if bound == 40 else 20_000)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    said = [None, "", "one two three four five six seven", "é" * 50, "x " * 40, "x " * 40, "word " * 3000, *texts()[30:60]]
    rows = [*enumerate(said), (4, said[4]), (None, "no id"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 as slot", "'clash' as part", "1 as th")
    made = {}
    for parts in (1, 5):  # the slots don't depend on partitions
        out = f"file://{tmp_path}/shards{parts}"
        got = shards.materialise(df.repartition(parts, "text"), out, path, P.PATTERN, 8, rows=16).collect()
        made[parts] = sorted((r.slot, -1 if r.doc_id is None else r.doc_id, r.seq_no, r.n_tokens, r.sha256) for r in got)
        files = sorted((tmp_path / f"shards{parts}").iterdir())
        assert {p.name.split(".")[-1] for p in files} == {"bin"}
        whole = b"".join(p.read_bytes() for p in files)
        assert all(hashlib.sha256(whole[16 * r.slot : 16 * r.slot + 16]).hexdigest() == r.sha256 and r.shard == r.slot // 16 for r in got) and len(whole) == 16 * len(got)
    assert made[1] == made[5]
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        for s in range(0, len(ids), 8):
            part = ids[s : s + 8]
            want.append((-1 if i is None else i, s // 8, len(part), hashlib.sha256(np.array(part + [50_256] * (8 - len(part)), "<u2").tobytes()).hexdigest()))
    assert sorted(r[1:] for r in made[1]) == sorted(want)
    assert [r[0] for r in made[1]] == list(range(len(want)))
    assert shards.materialise(df.limit(0), f"{out}-none", path, P.PATTERN, 8).count() == 0


def test_kernels_survive_slices():
    from datagauge.llm.kernels import buffers, shingle_hashes, slices

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a b c", None, "", "x" * 50, "a b"])})
    parts = list(slices(iter([batch, batch.slice(0, 0)]), "text", 6))
    assert sum(p.num_rows for p in parts) == 5
    whole, at = shingle_hashes(*buffers(batch.column("text")), 2)
    pieces = np.concatenate([shingle_hashes(*buffers(p.column("text")), 2)[0] for p in parts])
    assert (whole == pieces).all() and np.diff(at).tolist() == [2, 0, 0, 1, 1] and whole[0] == whole[3]


def test_a_worker_may_begin_with_empty_texts(monkeypatch):
    from datagauge.llm import kernels, quality, toxicity

    monkeypatch.setattr(kernels, "_powers", {})
    none = np.zeros(0, np.uint8), np.zeros(3, np.int64)
    assert kernels.prefix_hash(none[0]).tolist() == [0]
    assert quality.statistics(*none).shape == (2, quality.STATISTICS) and toxicity.terms(*none)[1].tolist() == [0, 0, 0]
