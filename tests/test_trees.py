import random

import pytest

from stratum.operators import trees as t

NODE = "tree long, node long, parent long, pos long, name string, dir string, file string, filter string"


def entries(spark, nodes, paths, target="full"):
    out = t.topic_entries(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(p,) for p in paths], "path string"), target)
    return [(r.ordinal, r.node, r.slug, r.title, r.path, list(r.topic_path), list(r.family)) for r in out.orderBy("tree", "ordinal").collect()]


def test_topics_inherit_and_are_cut(spark):
    nodes = [
        (1, 1, None, 1, "Install", "/install/", None, None), (1, 2, 1, 2, "Second", "", "b.adoc", " lite , full"), (1, 3, 1, 1, "Deep", "deep/", None, ""),
        (1, 4, 3, 1, "", None, "Über-x", None), (1, 5, 3, 2, "Lite only", None, None, "lite"), (1, 6, 5, 1, "Below it", None, "b", None),
        (1, 7, 3, 3, "Again", "../x", "none", None), (1, 8, 2, 1, "Repeat", None, "b", None), (1, 9, None, 2, "No dir", " ", None, None), (1, 10, 9, 1, "Lost", None, "b", None),
    ]
    assert entries(spark, nodes, ["install/b.adoc", "install/deep/Über-x.adoc", "install/deep/b.adoc", "b.adoc"]) == [
        (1, 4, "install__deep___ber_x", "Über-x", "install/deep/Über-x.adoc", ["Deep"], ["Install"]),
        (2, 2, "install__b", "Second", "install/b.adoc", ["Second"], ["Install"]),
    ]


def test_any_depth_cycles_and_several_parents(spark):
    chain = [(1, 0, None, 0, "r", "d", None, None)] + [(1, k, k - 1, 0, f"n{k}", None, f"f{k}", None) for k in range(1, 15)]
    assert [e[1] for e in entries(spark, chain, [f"d/f{k}.adoc" for k in range(15)])] == list(range(1, 15))
    loop = [(1, 0, None, 0, "r", "d", None, None), (1, 1, 0, 0, "a", None, "a", None), (1, 2, 1, 0, "b", None, "b", None), (1, 1, 2, 0, "a", None, "a", None), (1, 8, 9, 0, "x", None, "a", None), (1, 9, 8, 0, "y", None, "b", None)]
    assert [e[1] for e in entries(spark, loop, ["d/a.adoc", "d/b.adoc"])] == [1, 2]
    assert entries(spark, chain[:0], ["a"]) == []


def expand(spark, files, roots):
    out = t.expanded(spark.createDataFrame(list(files.items()), "path string, text string"), spark.createDataFrame([(r,) for r in roots], "path string"))
    return {r.root: (r.n_files, r.text) for r in out.collect()}


def by_recursion(files, root):
    """The walk itself, file by file."""
    seen, out = set(), []

    def visit(path):
        if path in seen or path not in files:
            return
        seen.add(path)
        for line in (files[path] or "").split("\n"):
            if line.startswith("include::"):
                target = line[len("include::") :].split("[")[0]
                for base in (path.rsplit("/", 1)[0] + "/" if "/" in path else "", ""):
                    parts = []
                    for p in (base + target).split("/"):
                        parts = parts[:-1] if p == ".." else parts + [p] * (p not in ("", "."))
                    if "/".join(parts) in files:
                        visit("/".join(parts))
                        break
            else:
                out.append(line)

    visit(root)
    return len(seen), "\n".join(out)


def test_includes(spark):
    files = {
        "a/root.adoc": "one\ninclude::../b/x.adoc[]\ntwo\ninclude::y.adoc[leveloffset=+1]\ninclude::gone.adoc[]\ninclude::{dir}/x.adoc[]\nthree",
        "b/x.adoc": "x1\ninclude::a/y.adoc[]\ninclude::a/root.adoc[]\nx2", "a/y.adoc": "y", "self.adoc": "s1\ninclude::self.adoc[]\ninclude::../../out.adoc[]\ns2", "empty.adoc": None,
    }
    got = expand(spark, files, ["a/root.adoc", "self.adoc", "empty.adoc", "nowhere"])
    assert got == {"a/root.adoc": (3, "one\nx1\ny\nx2\ntwo\nthree"), "self.adoc": (1, "s1\ns2"), "empty.adoc": (1, "")}


def test_attributes_hold_from_their_definition_on(spark):
    files = {"r": "{v} {w}\n:v: 1\ninclude::s[]\n{v} {w}\n:v: 3\n// comment\n{v}\n{unknown}\nifdef::x[]\nleft {unknown}\nendif::[]", "s": "{v}\n:v: 2\n:w: w{v}"}
    assert expand(spark, files, ["r"])["r"] == (2, "{v} {w}\n1\n2 w2\n3\nleft {unknown}")


@pytest.mark.parametrize("seed", range(2))
def test_each_file_once_in_the_order_of_the_walk(spark, seed):
    r = random.Random(seed)
    names = [f"{r.choice(['', 'd/', 'd/e/'])}f{k}" for k in range(12)]
    files = {n: "\n".join(f"{n}-{i}" if r.random() < 0.5 else f"include::{r.choice(names)}[]" for i in range(r.randrange(1, 7))) for n in names}
    files = {n: text + "\nend" for n, text in files.items()}
    got = expand(spark, files, names)
    # lines of one file may follow each other through blank parts
    want = {n: by_recursion(files, n) for n in names}
    assert {n: (c, [x for x in text.split("\n") if x]) for n, (c, text) in got.items()} == {n: (c, [x for x in text.split("\n") if x]) for n, (c, text) in want.items()}
