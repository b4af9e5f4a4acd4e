"""Inputs at which operators once failed or took for ever."""

import random
import time

import pytest

from lectern.llm import chat, decontaminate, html_extract, urls

R = random.Random(21)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n", "　", "  "])
def test_long_white_space_is_encoded_as_the_pattern_cuts_it(blank):
    codec = chat.codec(chat.default_vocabulary())
    for before, n, after in (("", 5000, ""), ("a", 5000, "b"), ("it's ", 4096, " 7"), ("x\x1c", 9001, "\x1cy"), ("é", 4097, "!" + blank * 4100)):
        text = before + blank * n + after
        assert codec.decode(codec.encode(text)) == text
        chat_ids = codec.encode(text).tolist()
        long_blank, chat._LONG_BLANK = chat._LONG_BLANK, chat.re.compile("(?!)")
        try:
            assert chat_ids == codec.encode(text).tolist()
        finally:
            chat._LONG_BLANK = long_blank


def test_a_million_blanks_in_a_conversation(spark):
    texts = [" " * 1_000_000 + "end", "\n" * 1_500_000, "word" + " \t" * 600_000]
    rows = spark.createDataFrame([(1, k, "assistant" if k else "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_conversations(rows)).first()
    assert out["n_turns"] == 3 and out["loss_chars"] == len(texts[1]) + len(texts[2])


@pytest.mark.parametrize("kind", ["int", "long", "string", "short", "decimal(10,0)"])
def test_items_have_ids_of_any_kind(spark, kind):
    text = " ".join(f"w{i}" for i in range(60))
    items = spark.createDataFrame([("7", text), ("8", "none of it is there at all to be found"), (None, text)], "item_id string, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text")
    docs = spark.createDataFrame([("1", "before " + text), ("2", None), ("3", "else")], "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    for found in (docs, docs.where("text = 'else'"), docs.limit(0)):
        out = decontaminate.find(found, items)
        rows = sorted((str(r["doc_id"]), str(r["item_id"])) for r in out.collect())
        assert rows == ([("1", "7"), ("1", "None")] if found is docs else []) and out.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert decontaminate.find(docs, items.limit(0)).count() == 0


def plainly(rules, host, path):
    best = (None, None)
    suffix = host
    while suffix:
        for rule, verdict in rules:
            h, _, p = rule.partition("/")
            if h == suffix and path.startswith("/" + p) and (best[0] is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        _, dot, suffix = suffix.partition(".")
        if not dot:
            break
    return best


def test_hosts_of_many_labels():
    rules = urls.Rules(urls.RULES)
    for _ in range(3000):
        host = ".".join(R.choice(["example", "www", "com", "net", "", "a"]) for _ in range(R.randint(0, 6)))
        path = R.choice(["", "/", "/en/x", "/es/", "/fr", "/fr/", "/e"])
        assert rules.find(host, path) == plainly(urls.RULES, host, path), (host, path)
    began = time.time()
    assert rules.find("a." * 1_000_000 + "example.com", "/en/")[0] == "example.com/en/"
    assert time.time() - began < 1


@pytest.mark.parametrize(
    "page,blocks",
    [
        ("<div>" * 100_000 + "x", 1),
        ("<div class=ad>" * 100_000 + "x", 1),
        ("<div>" * 20_000 + "</zz>" * 100_000 + "t", 1),
        ("<li><ul>" + "<div>" * 50_000 + "<li>a</li>" * 50_000, 50_000),
        ("<div class=ad>" * 50_000 + "<article>a</article>" * 50_000, 50_000),
        ("<span class=ad>" * 50_000 + "<div>a</div>" * 50_000, 1),
        ("<p>" * 100_000 + "x", 1),
        ("".join(f"</x{i}>" for i in range(100_000)) + "x", 1),
    ],
)
def test_pages_are_read_in_linear_time(page, blocks):
    began = time.time()
    found = html_extract.blocks_of(page)
    assert time.time() - began < 5 and (len(found) == blocks or blocks == 1 and len(found) >= 1)


def test_keys_meet_their_pages_by_a_join_as_by_broadcast(spark):
    pages = []
    for k in range(60):
        notice = "<div>Read our notice on every page</div>" if k % 3 else ""
        own = " ".join(R.choice("lorem ipsum dolor sit amet".split()) + str(R.randint(0, 99)) for _ in range(30))
        pages.append((k, f"http://h{k % 2}.org/{k}", f"<body><div class=banner>Shared head {k % 2}</div><article><p>{own}</p>{notice}</article><aside>{own[::-1]}</aside></body>"))
    pages += [(100, None, None), (101, "x", ""), *[(200 + k, "http://h1.org/copy", pages[1][2]) for k in range(30)], (1, "http://h0.org/1", pages[3][2])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    sent, joined = (sorted(map(tuple, html_extract.extract(frame, most_sent=most).collect()), key=str) for most in (html_extract.MOST_SENT, 0))
    assert sent == joined and len(sent) == len(pages) and any("notice" not in t for _, _, t, _ in sent if t)
    assert html_extract.extract(frame.limit(0), most_sent=-1).count() == 0
