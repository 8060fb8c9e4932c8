"""WARC archives, chat formatting, licence scans and the pipeline on small tables."""

import base64
import hashlib
import json
import random

import pytest

from skein.llm import chat, licenses, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, record int")


PAGES = [
    (3, "http://www.b.example.com/x?y#z", "<p>same</p>"), (1, "http://a.example.com/", "<p>same</p>"), (2, None, None), (4, "a\r\nWARC-Type: evil", ""), (5, "http://a.example.com/", "é\r\n\r\n\r\nline"),
    (6, "http://c.org", "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nafter\r\n\r\n"), (7, "http://c.org", "x" * 300_000), (8, "HTTP://User@C.org:80/P", "<p>same</p>"), (None, "http://c.org", "nobody"), (None, "u", "<p>same</p>"),
    (9, "q", "twice"), (9, "q", "twice"),
]


@pytest.mark.parametrize("least", [0, 5, 100])
def test_page_records(spark, least):
    found = warc.page_records(pages(spark, PAGES), revisit_bytes=least).collect()
    first = {}
    for k, _, html in PAGES:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    expected = []
    for k, _, html in PAGES:
        raw = (html or "").encode()
        refers = first.get(html or "") if len(raw) >= least and k != first.get(html or "") else None
        expected.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_histories_are_globally_ordered_and_intact(spark, monkeypatch):
    monkeypatch.setattr(warc, "MERGE_ROWS", 20)
    chance = random.Random(1)
    rows = [(k, f"http://h{chance.randint(0, 3) if k % 3 else 0}.example.com/{k % 5 if k % 3 else 'hot'}", f"text {k % 70}") for k in range(200)]
    out = warc.capture_histories(pages(spark, rows).repartition(7))
    assert out.rdd.getNumPartitions() > 3
    found = out.collect()
    order = [(r.url_key, r.captured, r.page_id) for r in found]
    assert order == sorted(order) and len(found) == 200
    assert all(r.intact for r in found)
    assert {r.page_id: r.url for r in found} == {k: u for k, u, _ in rows}


def test_damaged_archives_are_noticed(spark):
    record = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 500\r\n\r\nshort"
    path = f"{spark.conf.get('spark.checkpoint.dir')}/damaged"
    spark.createDataFrame([(record,)], "value string").write.mode("overwrite").option("lineSep", warc.END).text(path)
    with pytest.raises(Exception, match="cut off"):
        warc.read_runs(spark, path)


def test_empty_archives(spark):
    assert warc.page_records(pages(spark, [])).collect() == []


def test_url_keys():
    assert warc.url_key("http://www.B.example.com:80/x?y#z") == "com,example,b)/x?y"
    assert warc.url_key("https://u:p@c.org") == "org,c)/"
    assert warc.url_key("") == ")/"


def test_loser_tree():
    chance = random.Random(2)
    for n in range(9):
        runs = [sorted((chance.randint(0, 9), k) for _ in range(chance.randint(0, 6))) for k in range(n)]
        merged = list(warc.LoserTree([iter(r) for r in runs], lambda x: x[0]))
        assert merged == sorted((x for r in runs for x in r), key=lambda x: x)


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)}, indent=1)


def result(own, content):
    return json.dumps({"tool_call_id": own, "content": content})


TOOLS = {
    "add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "number"}, "y": {"type": "integer"}, "mode": {"type": "string", "enum": ["ok"]}}},
    "mul": {"properties": {"x": {"type": "integer"}}},
}


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", 'hi "x"\n'),
        (1, 1, "assistant", call({"id": "a", "name": "add", "arguments": {"y": 2, "x": 1.5, "z": {"b": 1, "a": [1, 2]}}})),
        (1, 2, "tool", result("a", "3")),
        (1, 4, "assistant", call({"id": "c", "name": "mul", "arguments": '{"x": "no"}', "depends_on": ["a"]})),
        (1, 3, "tool", result("c", '{"q":1}')),
        (1, 9, "tool", result("zz", "?")),
        (1, 5, "assistant", '{"tool_calls": nonsense'),
        (1, 6, "assistant", call({"id": "a", "name": "add", "arguments": {"x": 1, "mode": "bad"}})),
        (2, 0, "assistant", call({"id": "a", "name": "other", "arguments": [1]})),
        (2, 1, "assistant", call({"id": "b", "name": "mul", "arguments": [1]})),
        (2, 3, "assistant", call({"id": "p", "name": "mul", "arguments": {}, "depends_on": ["p"]})),
        (2, 4, "tool", result("p", "1")),
        (None, None, None, None),
    ]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, rid int")
    found = {(r.conv_id, r.turn): r for r in chat.format_chat(frame, chat.schema_table(spark, TOOLS)).collect()}
    assert len(found) == len(rows)
    assert found[1, 0].message == '{"content":"hi \\"x\\"\\n","role":"user"}'
    assert found[1, 1].message == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"x":1.5,"y":2,"z":{"a":[1,2],"b":1}},"id":"a","name":"add"}]}'
    assert found[1, 2].message == '{"content":"3","name":"add","role":"tool","tool_call_id":"a"}' and found[1, 2].call_turn == 1
    assert (found[1, 3].order_turn, found[1, 3].order_level) == (4, 1)
    assert (found[1, 4].order_turn, found[1, 4].problems) == (4, "mul.x: string instead of integer")
    assert found[1, 5].kind == "message" and found[1, 9].problems == "no call"
    assert found[1, 6].problems == "add.mode: not allowed; add.y: missing; repeated id"
    assert found[2, 0].problems == "unknown tool other" and found[2, 1].problems == "mul: arguments are no object"
    assert found[2, 3].problems == found[2, 4].problems == "circular"
    assert found[None, None].message == '{"content":null,"role":null}'
    for r in found.values():
        assert r.message == json.dumps(json.loads(r.message), separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    unchecked = chat.format_chat(frame).filter("problems LIKE '%unknown%' OR problems LIKE '%instead%'")
    assert unchecked.collect() == []


def test_long_chains_are_ordered(spark):
    """Calls whose results are needed by calls at earlier turns, ten deep."""
    rows = []
    for k in range(10):
        need = {"depends_on": [f"c{k - 1}"]} if k else {}
        rows += [(1, 10 - k, "assistant", call({"id": f"c{k}", "name": "t", "arguments": {}, **need})), (1, 0, "tool", result(f"c{k}", "r"))]
    found = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    kinds = [(r.order_turn, r.order_level) for r in sorted(found, key=lambda r: (r.order_turn, r.order_level))]
    assert kinds == [(10, k) for k in range(20)] and not any(r.problems for r in found)


def places_by_hand(turns, edges):
    """(turn, level) of each row after all that it follows; none for rows in circles and after them."""
    place = {}
    while True:
        ready = [x for x in range(len(turns)) if x not in place and all(f in place for f, t in edges if t == x)]
        if not ready:
            return place
        for x in ready:
            last = max((place[f] for f, t in edges if t == x), default=(-1, 0))
            place[x] = (turns[x], 0) if turns[x] > last[0] else (last[0], last[1] + 1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_places_of_random_links(spark, seed):
    chance = random.Random(seed)
    turns = [chance.randint(0, 30) for _ in range(120)]
    edges = {(chance.randrange(x), x) for x in range(1, 110) for _ in range(chance.choice((0, 1, 1, 1, 2, 3)))}
    edges |= {(110, 111), (111, 112), (112, 110), (112, 113), (113, 114), (5, 114), (114, 115)}
    nodes = spark.createDataFrame(list(enumerate(turns)), "rid long, turn long")
    found = chat._places(nodes, spark.createDataFrame(sorted(edges), "from long, to long")).collect()
    by_hand = places_by_hand(turns, edges)
    assert len(found) == 120 and {r.rid: (r.order_turn, r.order_level) for r in found if not r.circular} == by_hand
    assert all((r.order_turn, r.order_level) == (turns[r.rid], 0) for r in found if r.circular)


def test_schema_keywords(spark):
    tools = {"t": {"properties": {"a": {"type": "integer", "minimum": 0, "maximum": 5}, "b": {"type": ["string", "null"]}, "c": {"enum": [1.0, [2]]}}, "additionalProperties": False, "description": "x"}}
    rows = [{"a": 1.0, "b": None, "c": 1}, {"a": 1.5, "b": 3}, {"a": -1, "b": "", "c": [2]}, {"a": 6, "d": 1}, {"a": 5e0, "c": 2}]
    frame = spark.createDataFrame([(1, k, "assistant", call({"id": str(k), "name": "t", "arguments": a})) for k, a in enumerate(rows)], "conv_id long, turn long, role string, text string")
    found = {r.turn: r.problems for r in chat.format_chat(frame, chat.schema_table(spark, tools)).collect()}
    assert found == {0: "", 1: "t.a: number instead of integer; t.b: integer instead of string or null", 2: "t.a: too small", 3: "t.a: too large; t.d: unknown", 4: "t.c: not allowed"}
    for odd in ({"properties": {"a": {"pattern": "x"}}}, {"anyOf": []}, {"type": "array"}, {"additionalProperties": {}}):
        with pytest.raises(ValueError, match="can't check"):
            chat.schema_table(spark, {"t": odd})


def test_the_query_runs_the_method(spark):
    """op8's result on small conversations, with links, orders, circles and problems, against its SQL."""
    import duckdb

    from skein.llm import queries

    chance = random.Random(4)
    rows = [(c, t, "assistant" if (t + c) % 2 else "user", "é\"x\n" * chance.randint(0, 9) + "y" * (chance.randint(1300, 1700) if t == 5 else chance.randint(0, 40))) for c in range(40) for t in range(8)]
    rows += [(50, 0, "system", "s"), (50, 1, None, "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.format_chat(queries.tool_turns(turns), chat.schema_table(spark, {"reply": queries.REPLY})).collect()
    con = duckdb.connect()
    con.register("conversations", turns.toPandas())
    expected = con.sql(f"SELECT {', '.join(found[0].asDict())} FROM ({queries.ORACLE_SQL['op8_chat']})").fetchall()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    every = "; ".join(r.problems for r in found)
    for problem in ("circular", "no call", "repeated id", "unknown tool", "missing", "too large", "not allowed", ": unknown"):
        assert problem in every
    assert any(r.order_level > 0 for r in found)


def test_chat_of_an_empty_table(spark):
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_licenses(spark):
    mit = licenses.LICENSES["MIT"]
    wrapped = "Copyright (c) 2024 Someone\n\n" + mit.lower().replace("without restriction", "without\n   restriction").replace('"', "'") + "\n\nAll rights reserved.\n"
    spelled = licenses.LICENSES["BSD-3-Clause"].replace("copyright holder", "copyright owner").replace("COPYRIGHT HOLDER", "COPYRIGHT OWNER")
    texts = [
        (1, mit), (2, wrapped), (3, spelled), (4, mit + " and more"), (5, "text\n * Released under the MIT Licence.\nLicensed under CC BY-NC 4.0.\nmore"), (6, None), (7, " .\n"), (8, "Released under the MIT License."),
        (9, "Copyright 2020 Me\n" * 3), (10, "released under the mit license or not"), (8, "Released under the MIT License."), (None, "SPDX-License-Identifier: Apache-2.0\n" * 2), (11, "copyright notice law " * 20_000),
    ]
    docs = spark.createDataFrame([(d, t, "known", "lines") for d, t in texts], "doc_id long, text string, known string, lines string")
    found = licenses.scan(docs).collect()
    assert len(found) == len(texts)
    by = {r.doc_id: (r.license_id, r.notice_ids) for r in found}
    assert by == {
        1: ("MIT", ""), 2: ("MIT", ""), 3: ("BSD-3-Clause", ""), 4: (None, ""), 5: (None, "CC-BY-NC-4.0,MIT"), 6: (None, ""), 7: (None, ""), 8: ("MIT", "MIT"), 9: (None, ""), 10: (None, ""), 11: (None, ""), None: (None, "Apache-2.0"),
    }
    assert licenses.scan(docs.limit(0)).collect() == []
    own = licenses.known_table(spark, [("own", "Released under the MIT License.")])
    assert [r.license_id for r in licenses.scan(docs.filter("doc_id = 8"), licenses=own).collect()] == ["own", "own"]


def test_entire_texts_against_sql(spark):
    """Documents that are entire licences, wrapped and spelled otherwise, and some that aren't quite."""
    import textwrap
    from pathlib import Path

    import duckdb

    from skein.llm import queries

    texts = [t for _, t in licenses.license_texts()]
    texts += ["Copyright 2021 A. Person\n\n" + "\n\n".join(textwrap.fill(p, width) for p in t.split("\n")) for t in texts for width in (40, 72)]
    texts += [t + " or not" for t in texts[:5]] + [t[:-20] for t in texts[:5]] + ["Licensed under the MIT License", "", None]
    shipped = [(i, f) for i, name in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("GPL-2.0", "GPL-2"), ("MPL-2.0", "MPL-2.0")) for f in [Path("/usr/share/common-licenses", name)] if f.exists()]
    texts += [f.read_text() for _, f in shipped] + [f.read_text().upper().replace("\n", "\r\n   ") for _, f in shipped]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.scan(docs).collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    expected = con.sql(f"SELECT doc_id, text_digest, license_id, notice_ids FROM ({queries.ORACLE_SQL['op10_licenses']})").fetchall()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    ids = {r.doc_id: r.license_id for r in found}
    n = len(licenses.license_texts())
    assert [ids[k] for k in range(n)] == [i for i, _ in licenses.license_texts()]
    assert [ids[n + k] for k in range(2 * n)] == [i for i, _ in licenses.license_texts() for _ in range(2)]
    assert [ids[len(texts) - 2 * len(shipped) + k] for k in range(2 * len(shipped))] == [i for i, _ in shipped] * 2
    assert not any(ids[3 * n + k] for k in range(10)) and ids[3 * n + 10] == "MIT"


def test_pipeline(spark, tmp_path):
    """The stages on planted cases: what each drops, and what is left in the end."""
    import corpus_pipeline

    chance = random.Random(9)
    word = lambda: "".join(chance.choice("abcdefghijkl") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(20)) for k in range(3)]
    docs = [(k, prose(200)) for k in range(20)]
    docs += [(100, docs[0][1]), (101, "  " + docs[1][1] + "\n"), (102, None), (103, "12 34"), (104, prose(40) + " " + items[1][1]), (105, docs[2][1].upper())]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "xx", "s", 0) for d, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        function(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id for r in now.select("doc_id").collect()})
    everything = {d for d, _ in docs}
    assert left[0] == everything - {102, 103}
    assert left[1] == left[0] - {100, 1}
    assert left[2] == left[1] - {105}
    assert left[3] == left[4] == left[2] - {104}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == left[4]
    assert all(r.n_tokens == len(r.ids) > 0 for r in now.collect())
