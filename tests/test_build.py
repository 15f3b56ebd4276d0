"""An index from files to recall, injection and the command line, with a stand-in for the embedding service."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import cli, config
from lodestar.operators import fusion, residual
from lodestar.plans import build, inject, recall
from lodestar.sources import diaries, store
from lodestar.streaming import feed

DIM = 16


def embed(texts):
    """A bag of words: each word has a direction of its own."""
    out = []
    for t in texts:
        v = np.zeros(DIM)
        for w in t.lower().replace(",", " ").split():
            v += np.random.default_rng(sum(ord(c) * 131**i for i, c in enumerate(w)) % 2**32).normal(size=DIM)
        out.append([float(x) for x in v] if t.strip() else None)
    return out


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    words = "red green blue gold pink grey teal navy ruby jade".split()
    for i, w in enumerate(words):
        (root / f"n{i}.md").write_text(f"[2026-01-{i + 1:02d}] - ann\n[10:00]\n{w} stone in the {words[i - 1]} river\n\nTag: {w}, {words[i - 1]}, stone")
    return str(root), f"file://{tmp_path_factory.mktemp('home')}/store"


def test_life_of_an_index(spark, home):
    root, store_home = home
    assert build.rebuild(spark, root, store_home, embed, "bag@16") == 1
    assert build.refresh(spark, root, store_home, embed, "bag@16") == 1  # nothing changed
    index = build.opened(spark, store_home, "bag@16")
    tags = index.tags.orderBy("tag_id").collect()
    assert [t["tag_id"] for t in tags] == list(range(11)) and [t["name"] for t in tags] == sorted(t["name"] for t in tags)
    assert index.kernel.count() > 20 and index.basis is not None
    kept = build.basis_of(build.basis_table(spark, index.basis))
    assert np.allclose(kept.axes, index.basis.axes) and np.allclose(kept.mean, index.basis.mean)
    q = spark.createDataFrame([(0, embed(["ruby stone in the navy river"])[0])], "query_id long, vector array<double>").withColumn("vector", F.col("vector"))
    blocks = recall.recall(q, spark.createDataFrame([], "query_id long, name string"), index, config.merged({"recall": {"floor": 0.3}}))[0]
    assert blocks.filter("rank = 1 and not via_structure").first()["file"].endswith("n8.md")
    named = fusion.level_tags(residual.pyramid(q, index.tags), index.tags).collect()
    assert 0 < len(named) <= 8 and len({r["tag"] for r in named}) == len(named)

    talk = [(1, 0, "user", "ruby stone in the navy river"), (1, 1, "assistant", "yes"), (1, 2, "user", "ruby stone in the navy river"), (2, 0, "user", "something else entirely here")]
    turns = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    got = inject.injected(turns, lambda df, c: diaries.embedded(df, c, embed), index, config.merged({"injection": {"floor": 0.35}})).collect()
    assert (1, 0) in {(r["conv_id"], r["turn"]) for r in got} and all(len(r["text"]) <= 2000 for r in got)

    before = build.graph_fingerprint(index.tags, store.load(spark, store_home, "occurrences", "bag@16"))
    assert before == build.graph_fingerprint(index.tags.orderBy(F.desc("name")), store.load(spark, store_home, "occurrences", "bag@16"))
    assert cli.main(["doctor", store_home, root], spark) == 0 and cli.main(["stats", store_home, root], spark) == 0 and cli.main(["tags", store_home], spark) == 0
    with open(f"{root}/n99.md", "w") as f:
        f.write("free text without tags")
    assert cli.main(["doctor", store_home, root], spark) == 1 and cli.main(["doctor", store_home, root, "--sig", "other@16"], spark) == 1
    assert cli.main(["nonsense"], spark) == 2 and cli.main(["tags", store_home + "x"], spark) == 2
    assert build.refresh(spark, root, store_home, embed, "bag@16") == 2
    assert cli.main(["doctor", store_home, root], spark) == 0
    with pytest.raises(store.SignatureMismatch):
        build.refresh(spark, root, store_home, embed, "other@16")


def test_few_tags_give_an_empty_graph(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "a.md").write_text("one note\n\nTag: only")
    assert build.rebuild(spark, str(tmp_path / "root"), f"file://{tmp_path}/home", embed, "bag@16") == 1
    index = build.opened(spark, f"file://{tmp_path}/home", "bag@16")
    assert index.kernel.count() == 0 and index.basis is None
    q = spark.createDataFrame([(0, embed(["one note"])[0])], "query_id long, vector array<double>")
    assert recall.recall(q, spark.createDataFrame([], "query_id long, name string"), index, config.merged({"recall": {"floor": 0.1}}))[0].count() == 1


def counting(path):
    """The stand-in, and what it was asked for, by file, as it is called in workers."""

    def run(texts):
        with open(path, "a") as f:
            f.write("".join(t.replace("\n", " ") + "\n" for t in texts))
        return embed(texts)

    return run


def tables(spark, home, sig="bag@16"):
    get = lambda name: store.load(spark, home, name, sig)
    names = {r["tag_id"]: r["name"] for r in get("tags").collect()}
    occurrences = sorted((r["file"].rsplit("/", 1)[-1], names[r["tag_id"]], r["pos"]) for r in get("occurrences").collect())
    chunks = sorted((r["file"].rsplit("/", 1)[-1], r["chunk_index"], r["content"], [round(x, 6) for x in r["vector"]]) for r in get("chunks").collect())
    edges = sorted((names[r["src"]], names[r["dst"]], round(r["p"], 9)) for r in get("kernel").collect())
    return names, occurrences, chunks, edges


def test_refresh_embeds_what_changed_alone(spark, tmp_path):
    root, home, asked = tmp_path / "root", f"file://{tmp_path}/home", tmp_path / "asked"
    root.mkdir()
    for i, w in enumerate("red green blue gold".split()):
        (root / f"n{i}.md").write_text(f"about {w} things\n\nTag: {w}, stone")
    assert build.rebuild(spark, str(root), home, counting(asked), "bag@16") == 1
    before = tables(spark, home)[0]
    asked.write_text("")
    (root / "n1.md").write_text("about jade things\n\nTag: jade, stone, aqua")
    (root / "n9.md").write_text("about red rivers\n\nTag: red, river")
    (root / "n3.md").unlink()
    assert build.refresh(spark, str(root), home, counting(asked), "bag@16") == 2
    assert sorted(x.split(" Tag")[0].strip() for x in asked.read_text().split("\n") if x) == ["about jade things", "about red rivers", "aqua", "jade", "river"]
    names, occurrences, chunks, edges = tables(spark, home)
    assert all(names[i] == n for i, n in before.items())  # no tag is renumbered, and gold stays
    assert sorted(names) == list(range(8)) and [names[i] for i in (5, 6, 7)] == ["aqua", "jade", "river"]
    ids = [r["chunk_id"] for r in store.load(spark, home, "chunks", "bag@16").collect()]
    assert len(set(ids)) == len(ids) == 4 and max(ids) == 5
    fresh = f"file://{tmp_path}/fresh"
    build.rebuild(spark, str(root), fresh, embed, "bag@16")
    assert tables(spark, fresh)[1:] == (occurrences, chunks, edges)
    # The same changes once more change nothing, and take the graph over.
    files = diaries.read_diaries(spark, str(root)).filter("file like '%n1.md' or file like '%n9.md'")
    feed.applier(spark, home, embed, "bag@16")(files, 0)
    assert tables(spark, home)[1:] == (occurrences, chunks, edges)
    (tmp_path / "home" / "gen=4").mkdir()  # a generation that was cut short is none
    assert store.current(spark, home) == (3, "bag@16")


def test_watch(spark, tmp_path):
    import time

    root, home = tmp_path / "root", f"file://{tmp_path}/home"
    root.mkdir()
    (root / "a.md").write_text("one note\n\nTag: one, two")
    running = feed.watch(spark, str(root), home, embed, "bag@16", f"file://{tmp_path}/check", seconds=1, settled=0.2)
    try:
        for change, want in ((lambda: None, {"a.md"}), (lambda: (root / "b.md").write_text("more\n\nTag: two, three"), {"a.md", "b.md"}), (lambda: (root / "a.md").unlink(), {"b.md"})):
            change()
            began, got = time.time(), None
            while got != want and time.time() - began < 90:
                assert running.exception() is None
                time.sleep(1)
                got = {r["file"].rsplit("/", 1)[-1] for r in store.load(spark, home, "chunks", "bag@16").collect()} if store.current(spark, home) else None
            assert got == want
    finally:
        running.stop()


def test_save_and_update(spark, tmp_path):
    import datetime

    root, at = f"file://{tmp_path}/root", datetime.datetime(2026, 3, 4, 5, 6, 7)
    (tmp_path / "root" / "ann").mkdir(parents=True)
    stem = "2026-03-04-05_06_07-day"
    (tmp_path / "root" / "ann" / f"{stem}.md").write_text("there already")
    notes = [("ann", at, "day", "first text", ["a，b", " "]), ("ann", at, "day", "second text\n", ["x"]), ("ann", at, "day", None, ["x"]), ("ann", at, "day", "no tags", [" ", ""]), ("bob", at, "d?ay", "the target of the change", ["x", "y"])]
    got = store.saved(spark, root, spark.createDataFrame(notes, "agent string, ts timestamp, title string, content string, tags array<string>")).collect()
    assert sorted((r["agent"], r["file"], r["chunks"], r["error"]) for r in got if r["file"]) == [("ann", f"ann/{stem}-1.md", 1, None), ("ann", f"ann/{stem}-2.md", 1, None), ("bob", f"bob/{stem}.md", 1, None)]
    assert sorted(r["error"] for r in got if not r["file"]) == ["no content", "no tags"]
    assert (tmp_path / "root" / "ann" / f"{stem}-2.md").read_text() == "[2026-03-04] - ann\n[05:06]\nsecond text\n\nTag: x\n"
    assert (tmp_path / "root" / "ann" / f"{stem}.md").read_text() == "there already"
    asked = [(1, "the target of the change", "another text"), (2, "short", "x"), (3, "stands in no file at all", "x"), (4, "target of the change", "busy")]
    requests = spark.createDataFrame(asked, "request_id long, target string, replacement string")
    done = {r["request_id"]: r["error"] for r in store.updated(spark, root, requests).collect()}
    assert done == {1: None, 2: "too short", 3: "not found", 4: "busy"}
    assert "another text" in (tmp_path / "root" / "bob" / f"{stem}.md").read_text()
    assert {p.suffix for p in (tmp_path / "root").rglob("*.*") if p.is_file() and not p.name.startswith(".")} == {".md"}
    files = spark.createDataFrame([("f1", "the quick brown fox jumps", 1), ("f2", "the quick brown fox jumps twice: the quick brown fox jumps", 2)], "file string, raw string, mtime long")
    many = spark.createDataFrame([(1, "the quick brown fox", "x"), (2, "brown fox jumps twice", "y"), (3, "nothing of the kind", "z")], "request_id long, target string, replacement string")
    one = sorted(map(tuple, store.updates(files, many).collect()))
    limit, store.REQUESTS = store.REQUESTS, 0
    try:
        assert sorted(map(tuple, store.updates(files, many).collect())) == one
    finally:
        store.REQUESTS = limit
    assert [r[3] for r in one] == ["ambiguous", None, "not found"]


def test_command_line_rebuild(spark, tmp_path, capsys):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "a.md").write_text("one note\n\nTag: one, two")
    home = f"file://{tmp_path}/home"
    assert cli.main(["rebuild", home, f"{tmp_path}/nowhere"], spark, embed) == 2 and cli.main(["rebuild", home, f"{tmp_path}/root"], spark) == 2
    assert cli.main(["rebuild", home, f"{tmp_path}/root", "--sig", "bag@16"], spark, embed) == 0
    assert "1 files, 1 chunks" in capsys.readouterr().out
    assert cli.main(["tags", home], spark) == 0 and capsys.readouterr().out.splitlines() == ["one\t1\t1\tvector", "two\t1\t1\tvector"]
    assert cli.main(["doctor", home, f"{tmp_path}/root"], spark) == 0


def test_tag_lines(spark, tmp_path):
    lines = ['{"name": "b", "vector": [1, 2], "occurrences": [{"file": "x", "pos": 1}, {"file": "y", "pos": 2}]}', '{"name": "a", "vector": null, "occurrences": []}']
    (tmp_path / "good.jsonl").write_text("\n".join(lines))
    tags, occurrences = diaries.read_tags(spark, f"file://{tmp_path}/good.jsonl")
    assert sorted((r["tag_id"], r["name"], r["vector"]) for r in tags.collect()) == [(0, "b", [1.0, 2.0]), (1, "a", None)]
    assert sorted(map(tuple, occurrences.collect())) == [("x", 0, 1), ("y", 0, 2)]
    (tmp_path / "bad.jsonl").write_text(lines[0] + "\n{nonsense\n" + lines[1])
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        diaries.read_tags(spark, f"file://{tmp_path}/bad.jsonl")
    assert diaries.read_tags(spark, f"file://{tmp_path}/bad.jsonl", strict=False)[0].count() == 2
