"""Italian stemmer, after the published Snowball description of the algorithm."""

from __future__ import annotations

VOWELS = "aeiouàèìòù"

# Suffix lists of the published algorithm.
PRONOUNS = (
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene "
    "cela cele celi celo cene vela vele veli velo vene"
).split()
STANDARD = {
    "drop": "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti",
    "ic": "azione azioni atore atori",
    "log": "logia logie",
    "u": "uzione uzioni usione usioni",
    "ente": "enza enze",
    "rv": "amento amenti imento imenti",
    "adverb": "amente",
    "ity": "ità",
    "ive": "ivo ivi iva ive",
}
VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere "
    "erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire "
    "irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano "
    "ivate ivi ivo ono uta ute uti uto ar ir"
).split()

_KIND = {s: kind for kind, group in STANDARD.items() for s in group.split()}
_LONGEST = {n: sorted(x, key=len, reverse=True) for n, x in {"pronoun": PRONOUNS, "standard": list(_KIND), "verb": VERB}.items()}


def _mark(w: str) -> str:
    w = w.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    out = list(w)
    for i in range(1, len(w) - 1):
        if w[i] in "ui" and out[i - 1] in VOWELS and w[i + 1] in VOWELS:
            out[i] = w[i].upper()
    return "".join(out)


def _after(w: str, start: int) -> int:
    """Start of what follows the first non-vowel after a vowel."""
    for i in range(start + 1, len(w)):
        if w[i] not in VOWELS and w[i - 1] in VOWELS:
            return i + 1
    return len(w)


def _rv(w: str) -> int:
    if len(w) < 2:
        return len(w)
    if w[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(w)) if w[i] in VOWELS), len(w))
    if w[0] in VOWELS:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in VOWELS), len(w))
    return min(3, len(w))


def stem(word: str) -> str:
    w = _mark(word)
    rv, r1 = _rv(w), _after(w, 0)
    r2 = _after(w, r1)

    def longest(kind: str, text: str) -> str | None:
        return next((s for s in _LONGEST[kind] if text.endswith(s)), None)

    def cut(text: str, suffix: str, region: int) -> str | None:
        return text[: -len(suffix)] if text.endswith(suffix) and len(text) - len(suffix) >= region else None

    s = longest("pronoun", w)
    if s:
        base = w[: -len(s)]
        if base.endswith(("ando", "endo")) and len(base) - 4 >= rv:
            w = base
        elif base.endswith(("ar", "er", "ir")) and len(base) - 2 >= rv:
            w = base + "e"

    done = False
    s = longest("standard", w)
    if s:
        kind, at, base = _KIND[s], len(w) - len(s), w[: -len(s)]
        if kind == "rv":
            done = at >= rv
        elif kind == "adverb":
            done = at >= r1
        else:
            done = at >= r2
        if done:
            if kind == "adverb":
                x = cut(base, "iv", r2)
                if x is not None:
                    base = x
                    base = y if (y := cut(base, "at", r2)) is not None else base
                else:
                    base = next((y for t in ("abil", "os", "ic") if (y := cut(base, t, r2)) is not None), base)
            elif kind == "ic":
                base = x if (x := cut(base, "ic", r2)) is not None else base
            elif kind == "ity":
                base = next((y for t in ("abil", "ic", "iv") if (y := cut(base, t, r2)) is not None), base)
            elif kind == "ive":
                x = cut(base, "at", r2)
                if x is not None:
                    base = y if (y := cut(x, "ic", r2)) is not None else x
            w = base + {"log": "log", "u": "u", "ente": "ente"}.get(kind, "")
    if not done:
        s = next((s for s in _LONGEST["verb"] if w.endswith(s) and len(w) - len(s) >= rv), None)
        if s:
            w = w[: -len(s)]

    if w and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.lower()
