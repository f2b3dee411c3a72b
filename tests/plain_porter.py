"""Porter's algorithm one word at a time, by letter positions, to check the Columns against."""


def is_consonant(w, i):
    if w[i] in "aeiou":
        return False
    if w[i] == "y":
        return i == 0 or not is_consonant(w, i - 1)
    return True


def shape(w):
    """The word as a string of v and c, one letter per run."""
    out = ""
    for i in range(len(w)):
        kind = "c" if is_consonant(w, i) else "v"
        if not out.endswith(kind):
            out += kind
    return out


def measure(w):
    return shape(w).count("vc")


def has_vowel(w):
    return "v" in shape(w)


def double_consonant(w):
    return len(w) > 1 and w[-1] == w[-2] and is_consonant(w, len(w) - 1)


def cvc(w):
    n = len(w)
    return (n > 2 and is_consonant(w, n - 1) and not is_consonant(w, n - 2)
            and is_consonant(w, n - 3) and w[-1] not in "wxy")


STEP2 = """ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e
ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al
iviti ive biliti ble logi log""".split()
STEP3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def replace_suffix(w, table):
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            return rest + table[suffix] if measure(rest) > 0 else w
    return w


def pairs(words):
    return {a: b.replace("-", "") for a, b in zip(words[::2], words[1::2])}


def stem(w):
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]

    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double_consonant(w):
                    w = w if w[-1] in "lsz" else w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break

    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = replace_suffix(w, pairs(STEP2))
    w = replace_suffix(w, pairs(STEP3))

    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if measure(rest) > 1 and (suffix != "ion" or rest[-1] in "st"):
                w = rest
            break

    if w.endswith("e"):
        rest = w[:-1]
        if measure(rest) > 1 or measure(rest) == 1 and not cvc(rest):
            w = rest
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w
