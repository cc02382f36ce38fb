"""Scores and classes of mathematical text, as column expressions.

Symbol classes are explicit (no \\w or \\b), so that every engine counts alike. ``symbols`` are the
Greek letters and operators of mathematics, not ordinary letters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols of mathematics and their LaTeX commands.
LATEX = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "ρ": r"\rho",
    "σ": r"\sigma", "τ": r"\tau", "φ": r"\phi", "ω": r"\omega", "Γ": r"\Gamma", "Δ": r"\Delta", "Θ": r"\Theta", "Λ": r"\Lambda", "Π": r"\Pi", "Σ": r"\Sigma",
    "Φ": r"\Phi", "Ω": r"\Omega", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∇": r"\nabla", "√": r"\sqrt", "∞": r"\infty", "≤": r"\leq",
    "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "±": r"\pm", "×": r"\times", "÷": r"\div", "∈": r"\in", "→": r"\rightarrow",
}
SYMBOLS = "[" + "".join(LATEX) + "]"
OPERATORS = r"[+*/^()\[\]{}|-]"
EQUATIONS = (r"[A-Za-z_][A-Za-z0-9_]*[ \t]*=[ \t]*[^= \t]", r"[0-9]+[ \t]*=[ \t]*[^= \t]", r"=[ \t]*[A-Za-z0-9_]")
VARIABLES = r"(?:^|[^A-Za-z0-9_])([A-Za-z](?:[0-9]+|_[A-Za-z0-9]+)?)(?:$|[^A-Za-z0-9_])"
FRACTION = r"[0-9]+/[0-9]+|[A-Za-z_][A-Za-z0-9_]*/[A-Za-z_][A-Za-z0-9_]*"
SUBSCRIPT = r"[A-Za-z][A-Za-z0-9]*[_₀₁₂₃₄₅₆₇₈₉]"
SUPERSCRIPT = r"[A-Za-z_][A-Za-z0-9_]*[\^⁰¹²³⁴⁵⁶⁷⁸⁹]"
FINANCE = r"(return|variance|covariance|correlation|portfolio|sharpe|beta|alpha)"
# Texts that are no mathematics.
REJECT = (r"^[ \t]*[0-9]+[ \t]*$", r"^[ \t]*\[[ ]*[0-9]+[ ]*\][ \t]*$", r"^[ \t]*[A-Za-z][0-9]*[ \t]*$", r"^[ \t]*[0-9]+\.[ \t]*[A-Z][A-Za-z ]+$", r"(page|section|chapter|figure|table|equation|example)[ ]+[0-9]+", r"^[A-Z]{2,5}$", r"[0-9]{1,2}:[0-9]{2}", r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}")


# The detector's operators, finance terms and environments of several lines.
DETECTOR_OPERATORS = r"[+*/^()\[\]{}|⊗⊕⊙†‖∘-]"
DETECTOR_FINANCE = (
    r"(?i)(^|[^A-Za-z0-9_])(return|variance|covariance|correlation|portfolio|sharpe|beta|alpha)($|[^A-Za-z0-9_])",
    r"(^|[^A-Za-z0-9_])(E|Var|Cov)\([^\n]*?\)[A-Za-z0-9_]",
    r"(^|[^A-Za-z0-9_])[σμρβα]($|[^A-Za-z0-9_])",
)
ENVIRONMENTS = tuple(rf"(?s)\\begin\{{{e}\}}.*?\\end\{{{e}\}}" for e in (r"align\*?", r"gather\*?", "split", "cases", "array", r"eqnarray\*?"))
DETECTOR_SUBSCRIPT = r"[A-Za-z_][A-Za-z0-9_]*[_₀₁₂₃₄₅₆₇₈₉]"


# The patterns above in linear forms with the same matches: a name that fails at its first letter fails at all others, so
# only the first is tried; classes keep to ASCII, where one look-up decides, and other characters are read from ``signs``.
_LEAD = r"(?<![A-Za-z_])[A-Za-z_][A-Za-z0-9_]*+"
_EQUATIONS = (rf"{_LEAD}[ \t]*=[ \t]*[^= \t]", r"(?<![0-9])[0-9]++[ \t]*=[ \t]*[^= \t]", r"=[ \t]*[A-Za-z0-9_]")
_FRACTION = rf"(?<![0-9])[0-9]++/[0-9]+|{_LEAD}/[A-Za-z_][A-Za-z0-9_]*"
_SUBSCRIPT = r"(?<![A-Za-z])[A-Za-z][A-Za-z0-9]*+[_₀-₉]"
_SUPERSCRIPT = rf"{_LEAD}[\^⁰¹²³⁴-⁹]"
_DETECTOR_SUBSCRIPT = r"(?<![A-Za-z_])[A-Za-z_][A-Za-z0-9_]*[_₀-₉]"
_VARIABLE = r"(?<![A-Za-z0-9_])[A-Za-z](?:[0-9]+|_[A-Za-z0-9]+)?+(?![A-Za-z0-9_])"
FINANCE_WORDS = ("return", "variance", "covariance", "correlation", "portfolio", "sharpe", "beta", "alpha")


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def signs(c: Column) -> Column:
    """The characters beyond ASCII, in order."""
    return F.when(F.octet_length(c) > F.length(c), F.regexp_replace(c, r"[\x00-\x7F]+", "")).otherwise("")


def contains_any(c: Column, words) -> Column:
    """Whether one of the literal words is in the text; far cheaper than the same alternatives as a pattern."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def read(c: Column) -> Column:
    """Struct of a text (c), its lower case (low) and its signs (g), for ``bind``."""
    return F.struct(c.alias("c"), F.lower(c).alias("low"), signs(c).alias("g"))


def _equations(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("=")), hits(c, _EQUATIONS)).otherwise(0)


def _fraction(c: Column) -> Column:
    return F.contains(c, F.lit("/")) & has(c, _FRACTION)


def _subscripted(x: Column) -> Column:
    """Whether a subscript can be there at all; likewise ``_superscripted``."""
    return F.contains(x["c"], F.lit("_")) | has(x["g"], "[₀-₉]")


def _superscripted(x: Column) -> Column:
    return F.contains(x["c"], F.lit("^")) | has(x["g"], "[⁰¹²³⁴-⁹]")


def _if(gate: Column, n: Column) -> Column:
    return F.when(gate, n).otherwise(F.lit(0).cast("long"))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def has(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def hits(c: Column, patterns) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + has(c, p).cast("int")
    return out


def score(c: Column) -> Column:
    """Evidence that a text is mathematical: capped counts of symbols, equations, operators, variables and structure."""
    return bind(read(c), _score)


def _score(x: Column) -> Column:
    cap = lambda n, top: F.least(F.lit(float(top)), n.cast("double"))
    c, low, g = x["c"], x["low"], x["g"]
    holds = lambda *ws: F.lit(True) if not ws else F.contains(c, F.lit(ws[0])) & holds(*ws[1:])
    gates = (contains_any(low, FINANCE_WORDS), holds("(", ")"), has(g, "[σμρβα]"))
    finance = sum(((gate & has(c, p)).cast("int") for gate, p in zip(gates, DETECTOR_FINANCE)), F.lit(0))
    bracket = F.call_function("locate", F.lit("]"), c, F.call_function("locate", F.lit("["), c)) > 0
    structure = bracket.cast("int") + sum((F.contains(g, F.lit(s)).cast("int") for s in "∑∏∫"), F.lit(0))
    operators = count(c, r"[+*/^()\[\]{}|-]") + count(g, "[⊗⊕⊙†‖∘]")
    scripts = _if(_subscripted(x), count(c, _DETECTOR_SUBSCRIPT)) + _if(_superscripted(x), count(c, _SUPERSCRIPT))
    s = (
        cap(0.5 * count(g, SYMBOLS), 3) + cap(_equations(c), 2) + cap(0.2 * operators, 2) + cap(0.1 * F.size(variable_words(c)), 1.5)
        + cap(0.5 * finance, 2) + cap(structure, 2) + cap(1.5 * F.when(holds("\\begin{", "\\end{"), hits(c, ENVIRONMENTS)).otherwise(0), 3)
        + cap(0.3 * scripts, 1) + cap(0.5 * _if(holds("/"), count(c, _FRACTION)), 1)
        + F.when(holds("[MATHREF_") & has(c, r"\[MATHREF_[^\]]+\]"), 5.0).otherwise(0.0)
    )
    return F.when(has(c, r"[^ \t\n]"), s).otherwise(0.0)


def confidence(total: Column) -> Column:
    return F.least(F.lit(1.0), total / 18)


def rejected(c: Column) -> Column:
    """Page numbers, citations, headings, dates and the like, and long texts that are nearly all letters."""
    letters = (F.length(c) - F.length(F.regexp_replace(c, "[A-Za-z]+", ""))) / F.greatest(F.length(c), F.lit(1))
    return (hits(c, REJECT) > 0) | (F.length(F.trim(c)) < 3) | ((F.length(c) > 10) & (letters > 0.8))


def improved_score(c: Column) -> Column:
    return bind(read(c), _improved)


def _improved(x: Column) -> Column:
    cap = lambda n, top: F.least(F.lit(float(top)), n.cast("double"))
    c, low, g = x["c"], x["low"], x["g"]
    ops = count(c, r"[+*/^()\[\]{}|=<>-]") + count(g, "[≥≤≠≈±∓×÷∘]")
    yes = lambda b, v: F.when(b, float(v)).otherwise(0.0)
    sums = contains_any(g, "∑∏∫") | (F.contains(c, F.lit("[")) & has(c, r"[A-Z][ ]*=[ ]*\["))
    scripts = _if(_subscripted(x), count(c, _SUBSCRIPT)) + _if(_superscripted(x), count(c, _SUPERSCRIPT))
    named = contains_any(low, FINANCE_WORDS) & has(low, FINANCE + r"[ ]*[=:]")
    s = (
        cap(0.8 * count(g, SYMBOLS), 4) + yes(_equations(c) > 0, 2) + bind(ops, lambda n: F.when(n >= 2, cap(0.3 * n, 2)).otherwise(0.0))
        + yes(named, 1.5) + yes(sums, 2) + cap(0.5 * scripts, 1.5)
    )
    return F.when(rejected(c), 0.0).otherwise(s + yes(F.contains(c, F.lit("\n")), 1))


# Shapes of mathematical lines on a page.
LINE_PATTERNS = (
    r"[a-z][ ]*=[ ]*[a-z0-9()+*/^ -]+", r"[a-z][ ]*[+-][ ]*[a-z]", r"[a-z][0-9]*[ ]*[*/][ ]*[a-z][0-9]*", r"[a-z][0-9]+", r"[a-z]\^[0-9]+", r"\([a-z0-9+*/ -]+\)",
    r"[0-9]+/[0-9]+", r"[a-z][ ]*=[ ]*", r"[a-z]_[0-9a-z]+", r"\\[a-z]+", r"portfolio|return|variance|covariance|optim", r"sum|maximum|minimum|expected|mean",
)


# The patterns above as literals that a line must hold, and the rest to look for; None: the literal is all.
_LINE = (
    ("=", r"[a-z][ ]*=[ ]*[a-z0-9()+*/^ -]"), ("+-", r"[a-z][ ]*[+-][ ]*[a-z]"), ("*/", r"[a-z][0-9]*+[ ]*[*/][ ]*[a-z]"), ("", r"[a-z][0-9]"), ("^", r"[a-z]\^[0-9]"), ("(", r"\([a-z0-9+*/ -]+\)"),
    ("/", r"[0-9]/[0-9]"), ("=", r"[a-z][ ]*="), ("_", r"[a-z]_[0-9a-z]"), ("\\", r"\\[a-z]"), (("portfolio", "return", "variance", "optim"), None), (("sum", "maximum", "minimum", "expected", "mean"), None),
)


def line_score(c: Column) -> Column:
    """Score of one line of a page; 3 or more counts as mathematics."""
    shapes = lambda low: sum((F.coalesce((contains_any(low, ws) if ws else F.lit(True)) & (has(low, p) if p else F.lit(True)), F.lit(False)).cast("int") for ws, p in _LINE), F.lit(0))
    counted = lambda x: F.struct(x["c"].alias("c"), count(x["g"], SYMBOLS).alias("n"), shapes(x["low"]).alias("p"))
    return bind(bind(read(c), counted), _line_score)


def _line_score(x: Column) -> Column:
    c, n, p = x["c"], x["n"], x["p"]
    chars = F.length(F.replace(c, F.lit(" "), F.lit("")))
    structure = sum((F.contains(c, F.lit(s)).cast("int") for s in "=(+-*/^_"), F.lit(0))
    marks = F.length(c) - F.length(F.regexp_replace(c, r"[=+*/^()_0-9-]+", ""))
    ratio = (n + marks.cast("long")) / F.greatest(chars, F.lit(1))
    short = (F.length(c) < 100) & has(c, "[xyzijkmnpqr]") & has(c, r"[=+*/^(-]")
    return F.when(F.length(c) == 0, 0).otherwise(
        F.least(F.lit(3), n) + F.when(p >= 2, 2).when(p == 1, 1).otherwise(0) + bind(structure, lambda m: F.when(m >= 3, 2).when(m == 2, 1).otherwise(0))
        + F.when(short, 2).otherwise(0) + bind(ratio, lambda r: F.when(r > 0.4, 2).when(r > 0.2, 1).otherwise(0))
    ).cast("long")


def semantic_group(c: Column) -> Column:
    return bind(F.struct(c.alias("c"), F.lower(c).alias("low")), _group)


def _group(x: Column) -> Column:
    c, low = x["c"], x["low"]
    equals = F.length(c) - F.length(F.replace(c, F.lit("="), F.lit("")))
    return (
        F.when(contains_any(low, ("portfolio", "return", "variance", "weight")), "portfolio_theory")
        .when(F.contains(c, F.lit("=")) & has(F.trim(c), "^[A-Za-z][ ]*="), "variable_definition")
        .when((equals == 1) & has(c, r"[+*/-]"), "equation")
        .when(contains_any(low, ("/", "ratio", "rate")), "ratio")
        .when(contains_any(low, ("∑", "∏", "∫", "matrix")), "matrix_vector")
        .when(contains_any(low, ("prob", "expected")), "statistics")
        .otherwise("general_math")
    )


def variable_words(c: Column) -> Column:
    """Every single letter, indexed and subscripted name, in order."""
    return F.regexp_extract_all(c, F.lit(_VARIABLE), F.lit(0))


def variables(c: Column) -> Column:
    """Distinct single letters, indexed and subscripted names, and symbols, in alphabetical order."""
    return F.array_sort(F.array_distinct(F.concat(variable_words(c), F.regexp_extract_all(signs(c), F.lit(f"({SYMBOLS})"), F.lit(1)))))


def complexity(c: Column) -> Column:
    return bind(read(c), _complexity)


def _complexity(x: Column) -> Column:
    c, g = x["c"], x["g"]
    yes = lambda b, v: F.when(b, v).otherwise(0.0)
    return F.round(
        0.5 * count(g, SYMBOLS) + 0.3 * count(c, OPERATORS) + 0.4 * F.size(variables(c)) + _equations(c)
        + yes(_fraction(c), 1.0) + yes(_subscripted(x) & has(c, _SUBSCRIPT), 0.5) + yes(_superscripted(x) & has(c, _SUPERSCRIPT), 0.5), 2
    )


def to_latex(c: Column) -> Column:
    """Symbols to commands, trailing digits to subscripts, quotients to fractions; wrapped in dollars where it became LaTeX."""
    out = c
    for s, cmd in LATEX.items():
        out = F.replace(out, F.lit(s), F.lit(cmd + " "))
    out = F.regexp_replace(out, r"([A-Za-z])([0-9]+)(?![A-Za-z0-9_])", "$1_{$2}")
    out = F.regexp_replace(out, r"([A-Za-z])\^([0-9]+)(?![A-Za-z0-9_])", "$1^{$2}")
    out = F.regexp_replace(out, r"([A-Za-z0-9_{}]+)/([A-Za-z0-9_{}]+)", r"\\frac{$1}{$2}")
    wrap = ~F.startswith(out, F.lit("$")) & (has(out, r"[_^]") | F.contains(out, F.lit("\\")))
    return F.when(wrap, F.concat(F.lit("$"), out, F.lit("$"))).otherwise(out)


# Phrases of complexity levels and domains, mathematical signs of levels. White space is
# written out as the characters that all engines take for it; nothing else differs from the usual lists.
LEVELS = {
    "beginner": (r"introduction[ \t\r\n\f]+to|basic|fundamental|elementary|simple", r"primer|overview|getting[ \t\r\n\f]+started|basics", r"introductory|elementary|simple[ \t\r\n\f]+example"),
    "intermediate": (r"intermediate|moderate|standard|typical", r"application|practical|implementation", r"case[ \t\r\n\f]+study|real.world|empirical"),
    "advanced": (r"advanced|sophisticated|complex|rigorous", r"theoretical|mathematical[ \t\r\n\f]+proof|derivation", r"research|cutting.edge|state.of.the.art", r"phd|doctoral|graduate.level"),
}
LEVEL_SIGNS = (
    ("advanced", r"∫∫|∭|∂²|∇²|differential[ \t\r\n\f]+equation"),
    ("advanced", r"eigenvalue|eigenvector|matrix[ \t\r\n\f]+inverse|determinant"),
    ("intermediate", r"∫|∂|derivative|integral"),
    ("intermediate", r"∑|∏|summation|product"),
    ("beginner", r"[+\-*/=]|arithmetic|calculation"),
)
LEVEL_SYMBOLS = "[∫∂∑∏√±≤≥≠∞∈∉⊂⊆∪∩]"
DOMAINS = {
    "mathematics": (r"mathematical|theorem|proof|lemma|corollary", r"algebra|calculus|statistics|probability|geometry", r"analysis|topology|number[ \t\r\n\f]+theory"),
    "finance": (r"financial|portfolio|investment|trading|market", r"asset|security|bond|stock|option|derivative", r"risk[ \t\r\n\f]+management|capital|banking|hedge"),
    "economics": (r"economic|economy|econometric|microeconomic|macroeconomic", r"supply|demand|market[ \t\r\n\f]+equilibrium|elasticity", r"gdp|inflation|monetary|fiscal|policy"),
    "statistics": (r"statistical|regression|correlation|hypothesis", r"distribution|normal|gaussian|chi.square|t.test", r"confidence[ \t\r\n\f]+interval|p.value|significance"),
    "optimization": (r"optimization|minimize|maximize|constraint|lagrange", r"linear[ \t\r\n\f]+programming|quadratic[ \t\r\n\f]+programming|convex", r"objective[ \t\r\n\f]+function|feasible[ \t\r\n\f]+region|optimal"),
}


def literals(pattern: str) -> list[str] | None:
    """A text that each alternative needs, where all are plain words, blanks, dots and gaps; else None."""
    out = []
    for alt in pattern.replace(r"[ \t\r\n\f]+", "\0").split("|"):
        if not re.fullmatch(r"(?:[^\W_]|[. \0∫∭∂∇∑∏-])+", alt):
            return None
        out.append(max(re.split(r"[.\0]", alt), key=len))
    return out if all(out) else None


def _phrases(c: Column, pattern: str) -> Column:
    """Matches of a lexicon's pattern; read with it only where a word of it is there."""
    words = literals(pattern)
    return _if(contains_any(c, words), count(c, pattern)) if words else count(c, pattern)


def level(c: Column, lexicon: dict = LEVELS) -> Column:
    """Complexity level by counts of the lexicon's phrases, mathematical signs at double weight, length, and symbols."""
    def counted(x: Column) -> Column:
        n = {k: sum((_phrases(x["low"], p) for p in ps), F.lit(0)) for k, ps in lexicon.items()}
        for k, p in LEVEL_SIGNS:
            n[k] = n[k] + 2 * _phrases(x["c"], p)
        symbols, size = count(x["g"], LEVEL_SYMBOLS), F.length(x["c"])
        return F.struct(*[n[k].cast("long").alias(k) for k in ("beginner", "intermediate", "advanced")], symbols.alias("symbols"), size.alias("size"))

    def decided(y: Column) -> Column:
        symbols = y["symbols"]
        a = y["advanced"] + F.when(y["size"] > 2000, 1).otherwise(0) + F.when(symbols > 20, 2).otherwise(0)
        i = y["intermediate"] + F.when((symbols > 5) & (symbols <= 20), 1).otherwise(0)
        b = y["beginner"] + F.when(y["size"] < 500, 1).otherwise(0)
        return F.when((a > b) & (a > i), "advanced").when(b > i, "beginner").otherwise("intermediate")

    return bind(bind(read(c), counted), decided)


def domain(c: Column, lexicon: dict = DOMAINS, default: str = "finance") -> Column:
    """The domain with most hits; the first of equals in the lexicon's order; ``default`` without a hit."""
    def decided(n: Column) -> Column:
        top = F.array_max(n)
        out = F.when(top == 0, default)
        for i, k in enumerate(lexicon):
            out = out.when(F.get(n, F.lit(i)) == top, k)
        return out

    hit = lambda low: F.array(*[sum((_phrases(low, p) for p in ps), F.lit(0)).cast("long") for ps in lexicon.values()])
    return F.when(c.isNotNull(), bind(bind(F.lower(c), hit), decided))
