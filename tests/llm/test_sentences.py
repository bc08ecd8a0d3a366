import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from estateloom.llm import sentences as S

SENTENCES = {
    "en": ["Mr. A. Smith owns node-web-{n}.", "The plan covers St. Orvin and Sec. {n} only.", "We moved approx. {n} hosts, e.g. abc-db-0{n}, last week.", "It failed... and then recovered!", 'He wrote "Stop it!" in the ticket.', "Who still logs on to abc-web-{n}?", "The call starts at {n} p.m.", 'Ops said: "The copy is stale."'],
    "zh": ["系统目前运行{n}版本。", "「可以停机吗？」主管问道。", "等了很久……仍然没有结果！", "运维说：“备份已经过期。”"],
    "th": ["ระบบนี้ใช้ MySQL {n} อยู่ในตอนนี้", "ทีมงานยังรอการอนุมัติ", "เราต้องสำรองข้อมูลก่อนเสมอ"],
    "hi": ["बैकअप {n} तारीख को होगा।", "सर्वर तुरंत रोको!", "डॉ. A. Steele ने योजना को मंजूरी दी।"],
}


def corpus(seed, n=400):
    rng, docs, edges = random.Random(seed), [], []
    for i in range(n):
        text, at = "", []
        for _ in range(rng.randint(1, 4)):
            lang = rng.choice(list(SENTENCES))
            if text:
                text += "\n\n"
            for k in range(rng.randint(1, 6)):
                if k and lang != "zh":
                    text += " "
                at.append(len(text))
                text += rng.choice(SENTENCES[lang]).replace("{n}", str(rng.randint(2, 99)))
        docs.append((i, text))
        edges.append(at)
    return docs, edges


def test_held_out_accuracy(spark):
    docs, _ = corpus(1)
    model = S.train(spark.createDataFrame(docs, "doc_id bigint, text string"))
    held, want = corpus(2, 150)
    got = {}
    for r in S.sentence_units(spark.createDataFrame(held, "doc_id bigint, text string"), model).collect():
        got.setdefault(r.doc_id, set()).add(r.start_pos)
    truth = {(i, p) for i, at in enumerate(want) for p in at}
    made = {(i, p) for i, ps in got.items() for p in ps}
    hit = len(truth & made)
    assert hit / len(made) > 0.98 and hit / len(truth) > 0.98


@pytest.fixture(scope="module")
def model(spark):
    return S.Model(S.train(spark.createDataFrame(corpus(1)[0], "doc_id bigint, text string")))


def units(model, text):
    edges = S.starts(model, text)
    return [text[a:b].strip() for a, b in zip(edges, [*edges[1:], len(text)], strict=True)]


def test_structure(model):
    text = "# Plan v1.2. Draft\n\nOwner: Mr. X. Y\n\n| a | b |\n| --- | --- |\n| x. Y. | z |\n\n  - We moved approx. 3 hosts, e.g. abc-db-03, last week. Who still logs on to abc-web-3?\n- It failed... and then\n\nThe plan covers St.\nOrvin and Sec. 4 only. The call starts at 2 p.m."
    assert units(model, text) == [
        "# Plan v1.2. Draft", "Owner: Mr. X. Y", "| a | b |\n| --- | --- |", "| x. Y. | z |", "- We moved approx. 3 hosts, e.g. abc-db-03, last week.", "Who still logs on to abc-web-3?",
        "- It failed... and then", "The plan covers St.\nOrvin and Sec. 4 only.", "The call starts at 2 p.m.",
    ]


def test_quotes_and_scripts(model):
    assert units(model, '“One thing. Another thing.” said Mr. A. Smith.') == ['“One thing. Another thing.” said Mr. A. Smith.']
    assert units(model, "运维说：“备份已经过期。”系统目前运行3版本。「可以停机吗？」主管问道。") == ["运维说：“备份已经过期。”", "系统目前运行3版本。", "「可以停机吗？」主管问道。"]
    assert units(model, "ทีมงานยังรอการอนุมัติ ระบบนี้ใช้ MySQL 8 อยู่ในตอนนี้ ทีมงานยังรอการอนุมัติ") == ["ทีมงานยังรอการอนุมัติ", "ระบบนี้ใช้ MySQL 8 อยู่ในตอนนี้", "ทีมงานยังรอการอนุมัติ"]


def test_text_without_marks(model):
    """Scripts that write spaces only between sentences, and long text whose marks are left out."""
    lao = ["ລະບົບນີ້ເຮັດວຽກແລ້ວ", "ທີມງານຍັງລໍຖ້າການອະນຸມັດ", "ພວກເຮົາຕ້ອງສຳຮອງຂໍ້ມູນ"]
    khmer = ["ប្រព័ន្ធនេះដំណើរការ", "ក្រុមកំពុងរង់ចាំ"]
    assert units(model, " ".join(lao)) == lao and units(model, " ".join(khmer)) == khmer
    assert units(model, "ក្រុម កំពុងរង់ចាំ។ ប្រព័ន្ធ ដំណើរការ។") == ["ក្រុម កំពុងរង់ចាំ។", "ប្រព័ន្ធ ដំណើរការ។"]
    said = ["The copy is stale", "The plan covers the site", "Who still logs on to abc-web-4", "The copy is stale", "Who still logs on to abc-web-9", "The plan covers the site", "The copy is stale"]
    text = " ".join(said)
    assert S.slots(text, S.tokens(text, 0, len(text)), False)  # every gap may be a boundary, and the model decides
    assert len(S.slots("one line of a few words", S.tokens("one line of a few words", 0, 23), False)) == 0


def test_held_out_text_without_marks(spark):
    """Sentences of the training language without their marks and joined: found by the words that end and open them."""
    docs, _ = corpus(1)
    model = S.Model(S.train(spark.createDataFrame(docs, "doc_id bigint, text string")))
    rng, hit, made, true = random.Random(3), 0, 0, 0
    plain = [x for x in SENTENCES["en"] if x[0].isalpha() and x[:-1].replace("{n}", "").isascii() and not any(c in x[:-1].replace("{n}", "") for c in ".!?:\"")]
    for _ in range(60):
        text, want = "", set()
        while len(text.split()) < 40:
            text += " " * bool(text)
            want.add(len(text))
            text += rng.choice(plain).replace("{n}", str(rng.randint(2, 99))).rstrip(".?!")
        got = set(S.starts(model, text))
        hit, made, true = hit + len(got & want), made + len(got), true + len(want)
    assert hit / made > 0.9 and hit / true > 0.9


def test_a_bounded_share_trains(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(2000)], "doc_id bigint, text string")
    assert S.training_documents(df).count() == 2000
    assert 300 < S.training_documents(df, 40_000).count() < 500
    assert S._core("a" * 24 + "b") != S._core("a" * 24 + "c")  # long words stay apart


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n "), (4, "x"), (4, "x"), (5, "A b. " * 20000)], "doc_id bigint, text string")
    rows = S.sentence_units(df, {}).collect()
    assert {r.doc_id for r in rows} == {4, 5} and sum(r.doc_id == 4 for r in rows) == 2
    assert S.sentence_units(df.limit(0)).count() == 0


def test_posteriors_equal_enumeration(model):
    import itertools

    text = "It works. A. B. Smith left. ok. Then x."
    toks = S.tokens(text, 0, len(text))
    at = S.slots(text, toks, False)
    got = S.posteriors(model, text, toks, at)
    total, marg = 0.0, [0.0] * len(at)
    for events in itertools.product((0, 1), repeat=len(at)):
        p, by = 1.0, dict(zip(at, events, strict=True))
        for i in at:
            a, b = toks[i], toks[i + 1]
            after = toks[i + 2].core if i + 2 < len(toks) else "</s>"
            before = "<s>" if by.get(i - 1, 1 if i == 0 else 0) else toks[i - 1].core + S._tail_kind(toks[i - 1].tail)
            e = model.event(before, a)
            p *= e * max(model.start(b, after), 1e-12) if by[i] else (1 - e) * max(model.running(a, b, after), 1e-12)
        total += p
        marg = [m + p * e for m, e in zip(marg, events, strict=True)]
    assert got == pytest.approx([m / total for m in marg])


def test_all_documents_train(spark):
    """However long the texts are together (30 million characters here), the counts are those of all."""
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("It ends. It starts "), F.repeat(F.lit("x"), 100_000), F.lit(".")).alias("text"))
    model = S.train(df)
    assert model["passes|"] == 300 and model["k|.|1"] == 300 and model["k|.|c"] == 300 and model["b2|It|ends"] == 300


def counted_plainly(model, texts):
    """The counts of one pass by their definition, token by token and text by text."""
    counts = Counter()

    def event(before, a, what, n):
        kind = S._tail_kind(a.tail)
        wide = f"e1|{kind}|{a.core}" if a.tail else "e1||" if S._SPACELESS.match(a.last) else "e1|~|"
        counts.update({f"{k}|{what}": n for k in (f"k|{kind}", f"e0|{kind}|{S._shape(a.core)}", wide, f"e2|{kind}|{a.core}|{before}")})
        if what != "c" and a.tail:
            counts[f"z|{a.core}"] += n

    def start(b, after, n):
        counts.update({k: n for k in ("s|", f"s0|{S._shape(b.core)}|{b.quoted}", f"s1|{b.core}|{b.quoted}", f"s2|{b.core}|{after}", f"s3|{b.core}")})

    def runs(b, n):
        counts.update({k: n for k in ("r|", f"r0|{S._shape(b.core)}|{b.quoted}", f"r1|{b.core}|{b.quoted}")})

    for text in texts:
        for begin, end, whole in S.blocks(text):
            toks = list(S.tokens(text, begin, end)) if not whole else []
            if not toks:
                continue
            item = bool(S._ITEM.match(text[begin:end]))
            at = S.slots(text, S.tokens(text, begin, end), item)
            skip, behind = int(item and len(toks) > 1), {i + 1 for i in at}
            core = lambda i: toks[i].core if i < len(toks) else "</s>"  # noqa: B023, E731
            before = lambda i: toks[i - 1].core + S._tail_kind(toks[i - 1].tail) if i else "<s>"  # noqa: B023, E731
            start(toks[skip], core(skip + 1), 1)
            if any(c in S._ENDS for c in toks[-1].tail):
                event(before(len(toks) - 1), toks[-1], "1", 1)
            for i, a in enumerate(toks):
                if not a.first.islower():
                    counts[f"w1|{a.core}"] += 1
                    if i + 1 < len(toks):
                        counts[f"w2|{a.core}|{core(i + 1)}"] += 1
                if i > skip and i not in behind:
                    runs(a, 1)
                    if not toks[i - 1].tail:
                        counts.update((f"b1|{core(i - 1)}", f"b2|{core(i - 1)}|{a.core}"))
            for i, p in zip(at, S.posteriors(model, text, toks, at) if model else [None] * len(at), strict=True):
                event(before(i), toks[i], "c", 1)
                if p is not None:
                    a, b, kind = toks[i], toks[i + 1], S._tail_kind(toks[i].tail)
                    event(before(i), a, "x", p)
                    start(b, core(i + 2), p)
                    runs(b, 1 - p)
                    counts.update({k: 1 - p for k in (f"n|{kind}", f"n1|{kind}|{b.core}|{b.quoted}", f"n2|{kind}|{a.core}|{b.core}|{b.quoted}", f"n3|{kind}|{a.core}")})
        if model:
            counts["passes|"] += 1
    return {k: n for k, n in counts.items() if n >= 1.5}


def test_counts_equal_their_definition(spark, monkeypatch):
    docs = corpus(5, 60)[0]
    docs += [(100 + i, t) for i, t in enumerate(["- (a) x. Y? 1) Z", "1. A. B. C.\n- x\n- x", "x", "„Ja. Nein.“ sagte er... « Gut ! » Ja.", "ក្រុម កំពុងរង់ចាំ។ ប្រព័ន្ធ ដំណើរការ។", "A. B. C. D. E? 系统。「好。」A", "e.g. The plan ends here and v1.2 starts with abc-db-01 " * 8] * 3)]
    docs += [(200, None), (201, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    texts = [t for _, t in docs if t]
    once = counted_plainly(None, texts)
    twice = counted_plainly(S.Model(once), texts)
    assert S.train(df, 1) == once
    assert S.train(df) == pytest.approx(twice)
    whole, parts, handed_on = S.Observed(), Counter(), 0
    monkeypatch.setattr(S, "HELD", 50)  # what is handed on early adds up to the same
    seen = S.Observed()
    for t in texts:
        whole.add(t)
        seen.add(t)
        if seen.full():
            parts.update(seen.sums())
            seen.clear()
            handed_on += 1
    parts.update(seen.sums())
    assert handed_on > 1 and dict(parts) == whole.sums()
