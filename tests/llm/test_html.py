"""Rendering of pages as text."""

import random
import time

from quarrygraph.llm.html import extract, render


def text(html):
    return render(html)[0]


def test_blocks_and_spaces():
    assert text("<p>One\n  two<p>three <b>four</b>five<div>six</div>seven") == "One two\n\nthree fourfive\n\nsix\nseven"
    assert text("a<br>b<hr>c") == "a\nb\n\n---\n\nc"
    assert text("<h1>T</h1>x &amp; y&nbsp;z &copy;") == "T\n\nx & y z ©"
    assert text("<pre>  a\n   b</pre>") == "  a\n   b"


def test_lists():
    assert text("<ul><li>a<li>b<ol start=3><li>c</li><li>d</ol><li>e</ul>f") == "- a\n- b\n  3. c\n  4. d\n- e\n\nf"
    assert text("<dl><dt>k<dd>v<dt>l<dd>w</dl>") == "k\n    v\nl\n    w"


def test_tables():
    html = "<table><caption>C</caption><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>wide<tr><td>x<td>22</table>after"
    assert text(html) == "C\n\nName       N\nlong name  1\nwide\nx          22\n\nafter" or text(html) == "C\nName       N\nlong name  1\nwide\nx          22\n\nafter"
    assert text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert text("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>").splitlines()[0] == "a        b"


def test_visibility():
    assert text("a<script>x('</p>')</script><style>p{}</style><!-- n --><template>t</template>b") == "ab"
    assert text("<div hidden>a</div><p style='DISPLAY : none'>b</p><p style='visibility:hidden'>c<b style='visibility:visible'>d</b></p>e") == "d\n\ne"
    assert text("<head><title>t</title></head><body>b<input value=v><input type=hidden value=h><img alt='pic'></body>") == "bvpic"


def test_formulas_pictures_and_choices():
    assert text("a <math><mi>x</mi><mo>=</mo><mn>1</mn><semantics><annotation>TeX</annotation></semantics></math> b") == "a x=1 b"
    assert text("a<svg>loose<title>t</title><desc>d</desc><defs><text>n</text></defs><defs/><title/><path d='M'/><text>One</text><text><tspan>Two</tspan></text></svg>b") == "a One Two b"
    assert text("<svg><foreignObject><p>in</p></foreignObject></svg>out") in ("in\n\nout", "in\nout", "in out")
    assert text("<svg><g><p>never closed") == "never closed" and text("<p hidden off>a</p><p off value>b") == "b"
    assert text("x <select>no<option>a<option selected>b &amp; c<option>d</select> y") == "x b & c y"
    assert text("<select><option disabled>a<option>b<option>c</select>") == "b" and text("<select></select>z") == "z"
    assert text("<select><option disabled selected hidden>Choose<option>b</select>") == "Choose"
    assert text("<select multiple><optgroup label=G><option>a<option hidden>h<option label=L>b</optgroup></select>") == "G\na\nL"
    assert text("<div hidden><select><option>a</select></div><table><tr><td><select><option>a<option>b<td>c</table>") == "a  c"
    assert text("<select><option>a<input value=v>") == "av" and text("<pre><select>\n<option>\na\n</option></select></pre>") == "a"


def test_blank_lines_of_cells():
    assert text("<table><tr><td><p>a</p><p>b</p><td>c</table>") == "a  c\n\nb"


def test_broken():
    assert text(None) == "" and text("") == "" and text("<") == "<" and text("a < b") == "a < b"
    assert text("</div>x</p>y<b") == "x\n\ny<b" or text("</div>x</p>y<b").startswith("x")
    assert text("<script>never closed") == "" and text("x<!-- open") == "x"
    assert text("<div>" * 50000 + "deep") == "deep"


def test_never_fails():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "<td rowspan=3>", "</td>", "<ul>", "<li>", "</ul>", "<pre>", "</pre>", "text ", "&amp;", "<dd>", "<div hidden>", "</div>", "<select><option>o", "</select>", "<caption>", "\n", "<textarea>", "</textarea>", "<blockquote>", "'", '"', "<a b='", "<!--", "-->"]
    for _ in range(3000):
        render("".join(rng.choice(bits) for _ in range(rng.randrange(40))))


def test_words_survive():
    rng = random.Random(3)
    for _ in range(300):
        words, html = [], ""
        for k in range(rng.randrange(30)):
            w = f"w{k}x{rng.randrange(99)}"
            words.append(w)
            html += rng.choice(["<p>{}", "<div>{}</div>", "<li>{}", "<td>{}", "<tr><td>{}", "<table><tr><th>{}</table>", " {} ", "<b>{}</b> ", "<br>{}"]).format(w)
        got = text(html).replace("- ", " ").split()
        assert sorted("".join(got)) == sorted("".join(words))


# --- a plain layout of random pages ---------------------------------------------------------


def page(rng, depth=0, listed=False):
    """HTML of a random block, and its lines and gaps by the rules of the docstring."""
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))
    say = lambda: " ".join(word() for _ in range(rng.randrange(1, 6)))
    kind = rng.choice(["p", "div", "list", "table", "pre", "hidden", "quote"] if depth < 3 else ["p", "pre"])
    if kind == "p":
        s = say()
        return f"<p>{s.replace(' ', rng.choice([' ', chr(10) + '  ']))}" + rng.choice(["</p>", ""]), [1, s, 1]
    if kind == "pre":
        rows = [" " * rng.randrange(3) + word() for _ in range(rng.randrange(1, 4))]
        return f"<pre>{chr(10).join(rows)}</pre>", [1, *rows, 1]
    if kind == "table":
        rows = [[say() for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))]
        width = [max(len(r[c]) for r in rows if c < len(r)) for c in range(max(map(len, rows)))]
        lines = ["  ".join(x.ljust(width[c]) for c, x in enumerate(r)).rstrip() for r in rows]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in r) for r in rows) + "</table>", [1, *lines, 1]
    if kind == "list":
        ordered, html, out = rng.random() < 0.5, "", []
        for k in range(rng.randrange(1, 4)):
            s, inner = say(), [page(rng, depth + 1, True) for _ in range(rng.randrange(2))]
            mark = f"{k + 1}. " if ordered else "- "
            html += f"<li>{s}" + "".join(h for h, _ in inner)
            out += [mark + s, 0] + [x if isinstance(x, int) else " " * len(mark) + x for _, o in inner for x in o] + [0]
        tag = "ol" if ordered else "ul"
        return f"<{tag}>{html}</{tag}>", [0 if listed else 1, *out, 0 if listed else 1]
    inner = [page(rng, depth + 1, listed) for _ in range(rng.randrange(1, 4))]
    html, out = "".join(h for h, _ in inner), [x for _, o in inner for x in o]
    if kind == "hidden":
        return f"<div {rng.choice(['hidden', chr(39).join(['style=', 'display: none', ''])])}>{html}</div>", []
    if kind == "quote":
        return f"<blockquote>{html}</blockquote>", [1, *(x if isinstance(x, int) else "    " + x for x in out), 1]
    return f"<div>{html}</div>", [0, *out, 0]


def test_against_plain_layout():
    rng = random.Random(12)
    for _ in range(3000):
        blocks = [page(rng) for _ in range(rng.randrange(1, 5))]
        lines, gap = [], 0
        for x in (x for _, o in blocks for x in o):
            if isinstance(x, int):
                gap = max(gap, x)
            else:
                lines += ([""] * gap if lines else []) + [x]
                gap = 0
        html = "".join(h for h, _ in blocks)
        assert text(html) == "\n".join(lines), html


def test_time_grows_with_length():
    """Pages of about a megabyte that hold one piece of broken or odd markup again and again."""
    bits = ["<a ", "<a '", '<a ">" ', "<!-", "<!--", "<a <a>", "</b", "<td>x", "<td colspan=1000>x", "<td rowspan=9999>x", "<tr><td rowspan=50>x<td>y", "<blockquote>x", "<ul><li>x", "<dd>x", "<b>", "<b></i>", "<select><option>", "<script>", "&amp", "<p>", "<table><tr><td>", "<span>x</div>"]
    for x in bits:
        began = time.time()
        render("<table>" * x.startswith(("<td", "<tr")) + x * (1_000_000 // len(x)))
        assert time.time() - began < 60, x


def test_extract(spark):
    rows = [(1, "u", "<p>a", 5), (1, "u", "<p>a", 5), (None, None, None, None), (2, "v", "", 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("None", "", 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
