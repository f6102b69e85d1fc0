"""Template trees against a plain Python tree, and the cases that a tree must tell apart."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from blocktrace.llm import addresses

PAGES = "page_id long, url string, host string, template string, verdict string"


def judge(spark, urls, rules=addresses.RULES):
    """Rows of addresses; columns with the names of results must not disturb."""
    pages = spark.createDataFrame([(i, u, "x", "x", "x") for i, u in enumerate(urls)], PAGES)
    return {r.page_id: r for r in addresses.judge_urls(pages, rules=rules).collect()}


def likelihood(blocked, labelled):
    return sum(x * math.log(x) for x in (blocked, labelled - blocked) if x) - (labelled * math.log(labelled) if labelled else 0)


def plain_tree(shapes):
    """{(host, parts): (n, allowed, blocked)} to {(host, parts): (template, rate)}, by loops."""
    template = {key: () for key in shapes}
    for level in range(addresses.DEPTH):
        whole, held = defaultdict(int), defaultdict(int)
        for (host, parts), counts in shapes.items():
            whole[host, template[host, parts]] += counts[0]
            if len(parts) > level:
                held[host, template[host, parts], parts[level]] += counts[0]
        for host, parts in shapes:
            if len(parts) > level:
                above = template[host, parts]
                literal = held[host, above, parts[level]] >= addresses.LITERAL_SHARE * whole[host, above]
                template[host, parts] = (*above, parts[level] if literal else "*")
    for key in shapes:
        if len(key[1]) > addresses.DEPTH:
            template[key] = (*template[key], "**")
    for level in range(addresses.DEPTH, -1, -1):
        below = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for key, counts in shapes.items():
            t = template[key]
            if len(t) > level:
                for i in range(3):
                    below[key[0], t[:level], t[level]][t[level + 1:]][i] += counts[i]
        groups = defaultdict(list)
        for (host, prefix, head), rests in below.items():
            n, allowed, blocked = (sum(c[i] for c in rests.values()) for i in range(3))
            signature = frozenset(r for r, c in rests.items() if c[0] / n >= addresses.SIGNATURE_SHARE)
            groups[host, prefix, signature].append((head, blocked, allowed + blocked))
        names = {}
        for (host, prefix, _), found in groups.items():
            classes = []
            for head, blocked, labelled in sorted((f for f in found if f[2]), key=lambda f: (f[1] / f[2], f[0])):
                if classes:
                    _, b, all_ = classes[-1]
                    apart = 2 * (likelihood(b, all_) + likelihood(blocked, labelled) - likelihood(b + blocked, all_ + labelled))
                if classes and apart < addresses.APART:
                    classes[-1] = (classes[-1][0] + [head], b + blocked, all_ + labelled)
                else:
                    classes.append(([head], blocked, labelled))
            classes = [c[0] for c in classes]
            silent = [f[0] for f in found if not f[2]]
            if len(classes) == 1:
                classes[0] += silent
            elif silent:
                classes.append(silent)
            names |= {(host, prefix, head): "|".join(sorted(c)) for c in classes for head in c}
        for key in shapes:
            t = template[key]
            if len(t) > level:
                template[key] = (*t[:level], names[key[0], t[:level], t[level]], *t[level + 1:])
    nodes = defaultdict(lambda: [0, 0, 0])
    for key, counts in shapes.items():
        path = (*template[key], None)
        for i in range(3):
            for level in range(len(path) + 1):
                nodes[key[0], path[:level]][i] += counts[i]
    labelled = sum(c[1] + c[2] for c in shapes.values())
    base = sum(c[2] for c in shapes.values()) / labelled if labelled else 0.0
    out = {}
    for key in shapes:
        path, above, rate = (*template[key], None), -1, base
        for level in range(len(path) + 1):
            n, allowed, blocked = nodes[key[0], path[:level]]
            if n != above:
                rate = (blocked + addresses.PRIOR_WEIGHT * rate) / (allowed + blocked + addresses.PRIOR_WEIGHT)
            above = n
        out[key] = ("/" + "/".join(template[key]), rate)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_plain_tree(spark, seed):
    draw = random.Random(seed)
    rules = tuple(("h.com", f"/{a}/{b}/{i}", "block" if (b in "xy") != (draw.random() < 0.1) else "allow")
                  for a in "ab" for b in "uvxy" for i in range(4))
    words = [*"uvwxyz", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8))]
    urls = []
    for _ in range(300):
        depth = draw.choice([0, 1, 2, 3, 3, 3, 4, 8])
        parts = [draw.choice("ab"), draw.choice(words[:6] if draw.random() < 0.8 else words), str(draw.randint(0, 40))]
        parts += [draw.choice(["p", "q", "", "a|b", "*"]) for _ in range(max(0, depth - 3))]
        urls.append(f"http://{draw.choice(['h.com', 'h.com', 'm.h.com', 'other.net'])}/" + "/".join(parts[:depth]))
    rows = judge(spark, urls, rules)

    def shaped(part):
        for c in "\\{|*":
            part = part.replace(c, "\\" + c)
        return "{n}" if part.isdigit() else part

    counts, key_of = defaultdict(lambda: [0, 0, 0]), {}
    for i, url in enumerate(urls):
        host, path = url[7:].split("/", 1)
        key = key_of[i] = (host, tuple(shaped(p) for p in path.split("/") if p))
        counts[key][0] += 1
        if rows[i].rule:
            counts[key][1 if rows[i].verdict == "allow" else 2] += 1
    want = plain_tree(counts)
    for i, row in rows.items():
        template, rate = want[key_of[i]]
        assert row.template == template and row.purity == pytest.approx(rate, abs=1e-12)
        assert row.rule or row.verdict == ("block" if row.purity >= addresses.REJECT else "allow")
    assert len({r.template for r in rows.values()}) > 5 and any("|" in r.template.replace("\\|", "") for r in rows.values())


def test_deep_siblings_of_unlike_purity_stay_apart(spark):
    rules = tuple(("h.com", f"/x/bad/{i}", "block") for i in range(1, 6)) + tuple(
        ("h.com", f"/x/good/{i}", "allow") for i in range(1, 6))
    rows = judge(spark, [f"http://h.com/x/{kind}/{i}" for kind in ("bad", "good") for i in range(90)], rules).values()
    silent = [r for r in rows if r.rule is None]
    assert {(r.template, r.verdict) for r in silent} == {("/x/bad/{n}", "block"), ("/x/good/{n}", "allow")}


def test_alike_siblings_merge_and_share_a_verdict(spark):
    rules = tuple(("h.com", f"/{kind}/{i}", "block") for kind in "ab" for i in range(1, 6))
    rows = judge(spark, [f"http://h.com/{kind}/{i}/p" for kind in "abc" for i in range(90)], rules).values()
    assert {(r.template, r.verdict) for r in rows} == {("/a|b|c/{n}/p", "block")}


def test_odd_paths(spark):
    rows = judge(spark, [None, "", "http://h.com", "http://h.com//", "http://h.com/a//b/", "http://h.com/1/2/3/4/5/6/7/8",
                         "http://h.com/" + "a/" * 4000, "http://h.com/a|b/*/{n}"] * 2)
    assert rows[0].host == rows[0].path == "" and rows[2].template == rows[3].template == "/"
    assert rows[5].template.endswith("/**") and len(rows[6].template) < 40
    assert {r.verdict for r in rows.values()} == {"allow"}
    assert all(rows[i].template == rows[i + 8].template for i in range(8))
