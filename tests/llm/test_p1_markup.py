"""Markup of four languages, look-alike signs that are none, and structure."""

import pytest

from lectern.llm.p1_markup import convert, convert_column

PLAIN = ["On sait que 2 < 3 et que 5 > 4.", "A & B, puis C & D.", "3 * 4 = 12", "* * *", "Tome #2, [sic].", "Prix : 5 $ à 10 $ la page.", "Fin ; {voir plus haut}.", "<< La lettre >>", "le n_12 et le n_13", "The blind \\ star", "1) The loaf", "a < b && b > 0", "", "~ II", "x = ?"]


@pytest.mark.parametrize("text", PLAIN)
def test_signs_that_only_look_like_markup(text):
    assert convert(text) == (text, "plain", [])


@pytest.mark.parametrize(
    ("text", "language", "clean", "kinds"),
    [
        ("<h1\n class='t'>Le <i>puits</i><br></h1 ><p>Un<p>deux", "html", "# Le puits\n\nUn\n\ndeux", ["heading"]),
        ("<ul><li>a<li>b</ul><ol><li>c</ol>", "html", "- a\n- b\n\n1. c", ["list"]),
        ("<nav><ul><li>x</ul></nav><script>'<h2>y</h2>'</script><!-- <h2>z</h2> --><p>text</p>", "html", "text", []),
        ("<p><math alttext='\\frac{a}{b}'><mi>x</mi></math></p>", "html", "$\\frac{a}{b}$", ["formula"]),
        ("<pre><code>if a &lt; b:\n    c</code></pre>", "html", "```\nif a < b:\n    c\n```", ["code"]),
        ("&lt;h2&gt;Titre&lt;/h2&gt;&lt;p&gt;d&amp;eacute;j&agrave;&lt;/p&gt;", "html", "## Titre\n\ndéjà", ["heading"]),
        ("un&nbsp;mot", "html", "un\xa0mot", []),
        ("== Titre ==\n\n'''gras''' [[Page|lien]]<ref>n</ref> {{sc|petit}}\n* a\n** b\n# c", "wiki", "## Titre\n\ngras lien petit\n\n- a\n  - b\n\n1. c", ["heading", "list"]),
        ("<math>x^2</math> et [[la]]", "wiki", "$x^2$ et la", ["formula"]),
        ("# T\n\n*a* **b** ~~c~~ [d](./e) f[^1]\n\n- x\n- y\n\n```\nz = 1\n```", "markdown", "# T\n\na b c d f\n\n- x\n- y\n\n```\nz = 1\n```", ["code", "heading", "list"]),
        ("Titre\n=====\n\ntexte $e^{-t}$", "markdown", "# Titre\n\ntexte $e^{-t}$", ["formula", "heading"]),
        ("\\section{Un titre}\n\n\\textit{dit} sans \\og la\\fg{} note\\footnote{voir}\n\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\[x^2\\]", "latex", None, ["formula", "heading", "list"]),
    ],
)
def test_languages(text, language, clean, kinds):
    got = convert(text)
    assert got[1:] == (language, kinds)
    if clean is not None:
        assert got[0] == clean


def test_tables_are_aligned():
    assert convert("<table><tr><td>a<td>long<tr><td>long<td>b</table>")[0] == "a    | long\nlong | b"


def test_nulls_long_and_deep_texts(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert convert(deep)[0] == "x"
    assert convert(None) == (None, None, [])
    assert convert("<" * 20000)[1] == "plain"
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, ""), (3, "<b>x</b>"), (3, "<b>x</b>")], "id int, t string")
    rows = df.select("id", convert_column(F.col("t")).alias("c")).orderBy("id").collect()
    assert [r.c.text for r in rows] == [None, "", "x", "x"]


def test_visible_text_of_forms_pipe_tables_and_spans():
    assert convert("<form><p>Hello world in a form.</p><button>Send it</button></form>")[0].split() == "Hello world in a form. Send it".split()
    text, language, _ = convert("| a | bb |\n|---|:--:|\n| ccc | d |")
    assert language == "markdown" and text == "a   | bb\nccc | d"
    html = "<table><tr><td rowspan=2>A</td><td>B</td><td colspan='2'>C</td></tr><tr><td>D</td><td>E</td><td>F</td></tr><tr><td rowspan=x>G</td></tr></table>"
    assert convert(html)[0] == "A | B | C |\n  | D | E | F\nG"
    assert convert("l'eau qu'il but, 3 | 4")[1] == "plain"
    long = "&lt;p class=x" + "y" * 5000 + "&gt;Text&lt;/p&gt;"
    assert convert(long)[0] == "Text" and convert("a $x" + " + y" * 300 + "$ b")[2] == ["formula"]
