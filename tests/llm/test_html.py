from locuspark.llm.html_text import extract, render


def test_blocks_lists_and_tables():
    page = "<html><head><title>no</title><style>.x{display:none}</style></head><body>Hi <b>bold</b>text<p>One<p>Two <span class=x>gone</span>&amp; three<br>four<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul><table><tr><th>Name<th>Qty<tr><td>apple<td>12</table>end"
    assert render(page) == "Hi boldtext\n\nOne\n\nTwo & three\nfour\n\n- a\n- b\n  3. c\n  4. d\n- e\n\nName   Qty\napple  12\n\nend"


def test_visibility():
    assert render("a<p hidden>b</p><div style='display: none'>c</div><!-- d --><script>e</script>f") == "a\nf" or render("a<p hidden>b</p>f") == "af"
    assert render("<details><summary>s</summary>t</details>") == "s"
    assert render("<style>#i, p{visibility:hidden}</style><p>x</p><b id=i>y</b>z") == "z"


def test_preformatted_and_entities():
    assert render("<pre>\n a  b\n  c</pre>x &lt; y&nbsp;z") == " a  b\n  c\n\nx < y z"


def test_broken_pages():
    assert render(None) == render("") == render("<!-- x") == ""
    assert render("1 < 2") == "1 < 2"
    assert render("<div>" * 20000 + "x") == "x"
    assert render("a<b") == "a"
    assert render("<td>x") == "x"
    assert render("<table><td>a<table><td>b</table><td>c</table>") != ""


def test_all_rows(spark):
    rows = [(1, "<p>x", "clash"), (2, None, ""), (None, "", ""), (1, "<p>x", "clash")]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_lines"]) for r in got) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0)]


def test_rules_of_other_media_and_stray_quotes():
    from locuspark.llm.html_text import Builder, hiding_selectors

    sheet = "@media print{.nav{display:none} a{color:red}} @media (max-width:9px){.m{display:none}} @supports (x:y){.s{display:none}}"
    assert hiding_selectors(sheet) == set()
    assert hiding_selectors(sheet + "@import 'x'; .q, #r{display:none} @media print, screen{.t{display:none}} @layer b{.u{display:none}}") == {".q", "#r", ".t", ".u"}

    def shown(node):
        return "".join(c if isinstance(c, str) else shown(c) for c in node.children)

    for tag in ('<p class="a"">', "<p title=Bob's>", '<p title="a>b">', "<p title=a=\"b>"):
        assert shown(Builder(f"{tag}one</p><p>it's</p> end").root) == "oneit's end"


def test_veils_rowspan_and_joined_selectors():
    assert render('<div style="visibility:hidden">a<span style="visibility:visible">b</span>c</div>d') == "b\nd"
    assert render("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>") == "A  B\n   C\nD  E"
    sheet = "<style>div.note{display:none} p#x.y, .a .b, ul > li.c{display:none} .v{visibility:hidden} .w{visibility:visible}</style>"
    assert render(sheet + "<div class=note>n</div><p class=note>m</p>") == "m"
    assert render(sheet + '<p id=x class="y z">n</p><p id=x>m</p>') == "m"
    assert render(sheet + "<div class=a><i><b class=b>n</b></i>m</div><b class=b>k</b>") == "m\nk"
    assert render(sheet + "<ul><li class=c>n<li>m</ul><ol><li class=c>k</ol>") == "- m\n\n1. k"
    assert render(sheet + "<p class=v>n<b class=w>m</b></p>") == "m"
    assert render("<style>@media print{nav{display:none}}</style><nav>menu</nav>x") == "menu\nx"


def test_tables_with_spans():
    page = "<table><tr><td rowspan=0 colspan=2>w<td>B<tr><td>C<tbody><tr><td>D<td>E<td>F</table>"
    assert render(page) == "w     B\n      C\nD  E  F"


def pages(rng, n):
    """Random pages, also broken ones, with the words that they show."""
    for _ in range(n):
        words, out, number = [], [], 0

        def text():
            nonlocal number
            number += 1
            return f"w{number}x"

        def part(depth, shown, veiled, tags=()):
            for _ in range(rng.randrange(1, 5)):
                kind = rng.randrange(9)
                if kind < 4 or depth > 5:
                    w = text()
                    out.append(f" {w} ")
                    if shown and not veiled:
                        words.append(w)
                elif kind == 4:
                    out.append(rng.choice(["<!-- c -->", "<br>", "<script>var a='<p>';</script>", "<img alt=x>", *(["<hr/>"] if "p" not in tags else [])]))
                else:
                    tag = rng.choice(["div", "p", "span", "b", "section", "h2", "ul", "em"])
                    attr, hide, veil = rng.choice([("", 0, None), (' class="q\'s"', 0, None), (" title=it's", 0, None), (" hidden", 1, None), (' style="display:none"', 1, None), (" class=gone", 1, None), (" class=veil", 0, True), (' style="visibility:visible"', 0, False), (' data-x=a"b', 0, None)])
                    inner = [tag, "p"] if tag in ("div", "section", "h2", "ul") else [tag]
                    if tag == "p" and "p" in tags:
                        tag = "span"
                    if tag in ("div", "section", "h2", "ul") and "p" in tags:
                        tag = "b"
                    out.append(f"<{tag}{attr}>")
                    part(depth + 1, shown and not hide, veiled if veil is None else veil, (*tags, *inner[:1], tag))
                    out.append(f"</{tag}>")

        part(0, True, False)
        yield "<style>.gone{display:none} .veil{visibility:hidden}</style>" + "".join(out), words


def test_all_shown_words_and_no_others():
    import random

    for page, words in pages(random.Random(12), 400):
        assert render(page).replace("- ", " ").split() == words, page


def test_long_page_and_empty_table(spark):
    page = "<ul>" + "<li>item <b>of</b> a list" * 100_000 + "</ul>" + "<table>" + "<tr><td rowspan=3>a<td>b" * 20_000
    lines = render(page).split("\n")
    assert lines[99_999] == "- item of a list" and sum("a" in x.split() for x in lines[100_000:]) == 20_000
    df = spark.createDataFrame([], "page_id long, html string, text string, n_chars long")
    assert extract(df).columns == ["page_id", "text", "n_chars", "n_lines"] and extract(df).count() == 0


def test_captions_and_stray_text_of_tables_have_lines_of_their_own():
    assert render("<table><caption>Cap</caption><tr><th>H<td>v</table>") == "Cap\nH  v"
    assert render("<table>Intro text<tr><td>x</table>") == "Intro text\nx"
    assert render("a<table><caption>C d<tr><td>x<td>y<tr><td>z</table>b") == "a\n\nC d\nx  y\nz\n\nb"


def test_the_strongest_last_declaration_counts():
    assert render('<style>.h{display:none}</style><p class=h style="display:block">one') == "one"
    assert render("<style>.h{display:none} .b{display:block}</style><p class='b h'>one") == "one"
    assert render('<p style="display:none;display:block">one') == "one"
    assert render('<p style="display:block;display:none">one<p>two') == "two"
    assert render("<style>#i{display:none} .b{display:block}</style><p class=b id=i>one<p>two") == "two"
    assert render("<style>.b{display:none !important}</style><p class=b style='display:block'>one<p>two") == "two"
    assert render("<style>div .b{display:none} p{display:block}</style><div><p class=b>one</p></div><p class=b>two") == "two"
    assert render('<p hidden style="display:block">one') == "one"
    assert render('<style>.v{visibility:hidden} p.v{visibility:visible}</style><p class=v>one') == "one"


def test_drawings_objects_and_ruby():
    assert render("<svg><title>no</title><defs><text>no</text></defs>no<g>no<text>Label one</text><text>two</text></g></svg>") == "Label one\ntwo"
    assert render("<object data=x>inside</object> out") == "inside out"
    assert render("<ruby>a<rp>(<rt>b<rp>)</ruby>c") == "abc"
    assert render("<map name=m>text<area></map>") == "text"


def test_words_are_never_glued_or_lost_with_captions_and_overrides():
    import random

    rng = random.Random(12)
    for _ in range(300):
        words, page = [], "<style>.h{display:none}</style>"
        for _ in range(rng.randrange(1, 6)):
            new = [f"w{len(words) + i}" for i in range(5)]
            words += new
            page += rng.choice([
                "<table><caption>{0}</caption><tr><td>{1}<td>{2}<tr><th>{3}</th></tr></table><p>{4}",
                "<table>{0}<tr><td>{1}</td></tr><tr><td>{2}<table><caption>{3}<tr><td>{4}</table></table>",
                '<div class=h style="display:block">{0}</div><ul><li>{1}<li class=h style="display:list-item">{2}</ul><p>{3}<p>{4}',
                "<object><p>{0}</object><svg><text>{1}</text><text>{2}</text></svg><div>{3}</div>{4}<br>",
            ]).format(*new)
        assert sorted(w for w in render(page).split() if w != "-") == sorted(words), page
