import base64
import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, mixing, quality_rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, "  \n\t ", "one", "a b\na b\na b\n", "x\n\nx\n y\nx", "é ü 漢字   #%& <|>", "w " * 400, "abc def\n" * 50, " ".join(map(str, range(3000))), "\nlead", "\nfoo bar\nfoo bar", "\nq r\nq r\n", "\n\nx\nx", "a\r\na\r\na", "trail\n", "", "\n", "q" * 5000, "long line of words " * 40_000 + "\n" + "long line of words " * 40_000]


def brute_words(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = collections.Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words))


def test_word_statistics_match_brute_force(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["a", "bb", "#c", "d\n", "é\n\n"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules.compression_bands(docs).collect()}
    assert got == {i: brute_words(t) for i, t in enumerate(texts)}
    assert quality_rules.compression_bands(docs.limit(0)).count() == 0


def test_bands_reject_repetitive_and_incompressible(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("tha on er ing re st ou le de ment qui von ich ein sp ka lo mi nu pa".split()) for _ in range(rng.randrange(1, 4))) for _ in range(900))
    noise = base64.b85encode(rng.randbytes(6000)).decode()
    noise = " ".join(noise[i : i + 9] for i in range(0, len(noise), 9))
    line = " ".join(f"w{i}" for i in range(7)) + " "
    half = prose + " " + ("lorem ipsum dolor " * 900)
    docs = spark.createDataFrame([(1, prose), (2, noise), (3, line * 300), (4, half), (None, prose)], "doc_id long, text string")
    kept = [(r.doc_id, r.kept) for r in quality_rules.compression_bands(docs).collect()]
    assert dict(kept) == {1: True, 2: False, 3: False, 4: False, None: True} and len(kept) == 5


def test_water_fill_and_apportionment():
    sizes, weights = [100, 10, 1000, 0], [3, 1, 2, 3]
    t = mixing.water_fill(sizes, weights, 1.5 * sum(sizes), 2)
    assert t[0] == 200 and t[1] == 20 and t[3] == 0 and t[2] == pytest.approx(1.5 * 1110 - 220)
    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    rng = random.Random(3)
    for _ in range(200):
        votes = [rng.randrange(0, 50) for _ in range(rng.randrange(1, 8))]
        most = [rng.randrange(0, 20) for _ in votes]
        seats = rng.randrange(0, 60)
        got = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if votes[i] and got[i] < most[i]]
            if not open_:
                break
            got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        fast = mixing.sainte_lague(votes, seats, most)
        assert sum(fast) == sum(got)
        quotients = lambda g: sorted(votes[i] / (2 * s + 1) for i in range(len(votes)) for s in range(g[i]))
        assert quotients(fast) == pytest.approx(quotients(got))


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(0, 400))), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(600)]
    rows += [(5, "same id twice", "a"), (None, "no id here", "a"), (7001, None, "b"), (7002, "", "only empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix_sources(docs, shard_words=5000).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = mixing.water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    for s, n, t in zip(names, sizes, want):
        assert by[s][0].source_size == n and by[s][0].target == pytest.approx(t)
        assert abs(sum(r.taken for r in by[s]) - t) <= 16 * (n // 5000 + 3)
    again = mixing.mix_sources(docs.repartition(7), shard_words=5000).collect()
    key = lambda r: (r.doc_id or -1, r["size"], r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_warc_round_trip_rejects_records_in_payloads(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>a</p>", fake, "x" + fake * 3 + "WARC/1.0\r\n", None, "", "<p>a</p>", "é漢\r\n\r\n", fake, "tail\r\n\r", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n"]
    rows = [(i, None if i == 2 else f"http://x/{i}\r\nq", h) for i, h in enumerate(html)] + [(None, "u", "<p>a</p>"), (4, "again", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    for least in (0, 5):
        path = str(tmp_path / f"w{least}")
        warc.write_warc(pages, path, min_bytes=least, per_file=3)
        got = sorted((tuple(r) for r in warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
        want = []
        for i, _, h in rows:
            b = (h or "").encode()
            first = min(k for k, _, x in rows if k is not None and (x or "") == (h or ""))
            again = i != first and len(b) >= least
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
        assert got == sorted(want, key=str)
    said = warc.read_warc(spark, path, payloads=True).where("page_id = 1").first()
    assert said.target_uri == "http://x/1%0D%0Aq" and said.date.endswith("Z") and said.payload.decode() == fake and said.record_id == "<urn:page:1>"
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_pointer_jumping_stops_at_a_break():
    import numpy as np

    off = np.array([0, 5, 9, 20, 33, 50])
    assert warc.reachable(off, np.array([9, 20, 33, 50, 60, -1])).tolist() == [True, False, True, False, True, False]
    assert warc.reachable(off[1:], off[1:]).tolist() == [False] * 5
    assert warc.reachable(off[:0], off[:0]).tolist() == []


def test_template_language():
    run = lambda s, **k: "".join(t for t, _ in chat.compile_template(s)([{"role": "u", "text": "T"}, {"role": "v", "text": "W"}], **k))
    assert run("{% for m in messages %}{{ loop.index }}{{ m['text'] | lower }}{% if not loop.last %}, {% endif %}{% endfor %}") == "1t, 2w"
    assert run("{% if x == 1 %}a{% elif x == 2 %}b{% else %}c{% endif %}", x=2) == "b"
    assert run("a  {%- set y = 'p' ~ 3 -%}  {{ y + 'q' }}{# note #}", x=2) == "ap3q"
    assert run("{{ x.__class__ }}{{ x.k }}", x={"k": "v"}) == "v"
    assert chat.fold(chat.parse("{{ 'a' + 'b' }}c{% if 1 == 2 %}z{% endif %}{{ 'D' | lower }}")) == (chat.Text("abcd"),)
    assert run("{{ '}}' ~ \"%}\" }}{% if x == '%}' %}y{% endif %}{# '}} #}", x="%}") == "}}%}y"
    assert run("{%\tfor\tm in messages %}{{ 3 - 1 - loop.index0 }}{{ -loop.index }}{%endfor%}") == "2-11-2"
    assert run("{% if x %}{%- elif\ty -%} a {%- else -%} b {%- endif %}", y=1) == "a"
    for wrong in ("{{ x | length }}", "{{ x + 1 }}", "{% for a in x.n %}{% endfor %}", "{{ 'a' < x.n }}"):
        with pytest.raises(chat.TemplateError):
            run(wrong, x={"n": 1} if "x.n" in wrong else None)
    many = "{% for a in x %}" * 5 + "{{ a }}" + "{% endfor %}" * 5
    with pytest.raises(chat.TemplateError):
        run(many, x=list(range(50)))
    with pytest.raises(chat.TemplateError):
        run("{% set t = 'a' %}" + "{% set t = t ~ t %}" * 40)
    for bad in ("{{ none | length }}", "{{ 1 + 'a' }}", "{{ x", "a {% if x", "{# note", "{{ x %}", "{% for %}", "{{ f(1) }}", "{{ x | nope }}", "{% if a %}", "{{ 'a }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_chat_round_trip(spark):
    texts = ["", None, "a\\", "<|im_end|>\n<|im_start|>assistant\nhi", "\\<|\\\\n", "é漢😀", "<", "|>", "z" * 200_000]
    rows = [(c, t, ["user", "assistant", None, "sys\ntem<|"][(c + t) % 4], texts[(c * 3 + t) % len(texts)]) for c in range(9) for t in range(7)]
    rows += [(1, 3, "assistant", "tie"), (1, 3, "assistant", "tie"), (None, 0, "assistant", "x"), (3, None, "user", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(0)).repartition(5)
    got = {r.conv_id: r for r in chat.digest_conversations(chat.format_conversations(turns)).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert got.keys() == by.keys()
    for conv, own in by.items():
        own.sort(key=lambda r: ((r[1] is not None, r[1]), (r[2] is not None, r[2]), (r[3] is not None, r[3])))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_warc_members_archives_and_foreign_files(spark, tmp_path):
    import glob
    import gzip

    big = "".join(random.Random(9).choices("abcdefgh ", k=20_000_000))  # more than a member holds
    pages = spark.createDataFrame([(1, "u", big), (2, "u", "x" * 3000), (3, "u", "y"), (4, None, "z" * 3000)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "own")
    warc.write_warc(pages, path, most_bytes=4000, date="2020-01-02T03:04:05Z")
    files = [open(f, "rb").read() for f in glob.glob(f"{path}/archive=*/part-*")]
    plain = sorted((gzip.decompress(f) for f in files), key=len)
    assert all(x.startswith(b"WARC/1.1\r\n") and b"\r\nWARC-Date: 2020-01-02T03:04:05Z\r\n" in x for x in plain)
    assert all(x.count(b"WARC/1.1\r\n") == 1 or len(x) <= 4000 for x in plain)
    for f in files:  # each record can be unpacked by itself
        begins = [m.start() for m in re.finditer(rb"\x1f\x8b\x08\x00\x00\x00\x00\x00", f)]
        assert len(begins) >= gzip.decompress(f).count(b"WARC/1.1\r\n")
    assert {r.page_id: r.payload_bytes for r in warc.read_warc(spark, path).collect()} == {1: len(big), 2: 3000, 3: 1, 4: 3000}
    record = lambda v, n: f"WARC/{v}\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\ncontent-length: {n}\r\n\r\n".encode() + b"r" * n + b"\r\n\r\n"
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.warc").write_bytes(record("1.0", 3) + record("1.1", 5))
    (other / "b.warc.gz").write_bytes(gzip.compress(record("1.0", 7) + record("1.1", 0)) + gzip.compress(record("1.1", 2)))
    (other / "c.warc").write_bytes(b"")
    got = sorted((r.path.rpartition("/")[2], r.off, r.payload_bytes) for r in warc.read_warc(spark, str(other)).collect())
    assert [x[::2] for x in got] == [("a.warc", 3), ("a.warc", 5), ("b.warc.gz", 7), ("b.warc.gz", 0), ("b.warc.gz", 2)]


def test_warc_candidates_cost_is_linear_in_nested_records():
    import time

    def took(k):
        nested = b"WARC/1.0\r\nContent-Length: 9\r\n" * k + b"\r\n"
        raw = b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(nested), nested)
        began = time.perf_counter()
        off, following = warc.candidates(raw)
        assert len(off) == k + 1 and warc.reachable(off, following).sum() == 1 and following[0] == len(raw)
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 30 * max(took(8000), 0.005)
