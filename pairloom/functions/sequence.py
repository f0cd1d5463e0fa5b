"""Sequence functions: Column in, Column out, all inside the JVM.

Overlapping k-mers come from one look-ahead regular expression, which is linear
in the text (``substring`` walks from the start each time) and gives an empty
array for texts shorter than k.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: alphabets
RNA = "AUGC"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
AMINO_EXTENDED = "XBZJUO"
# fixed values: the seven residue classes of the conjoint triad
TRIAD_CLASSES = ["AGV", "ILFP", "YMTS", "HNQW", "RK", "DE", "C"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_rna(c) -> Column:
    return F.translate(F.upper(F.trim(_c(c))), "T", "U")


def clean_rna(c) -> Column:
    return F.regexp_replace(normalize_rna(c), f"[^{RNA}]", "")


def is_strict_rna(c) -> Column:
    return normalize_rna(c).rlike(f"^[{RNA}]+$")


def clean_aptamer(c) -> Column:
    """Strip end marks, keep ACGU; null under five letters."""
    t = F.translate(F.upper(_c(c)), "T", "U")
    t = F.regexp_replace(t, "^5['′]?", "")
    t = F.regexp_replace(t, "3['′]?$", "")
    t = F.regexp_replace(t, "[^ACGU]", "")
    return F.when(F.length(t) >= 5, t)


def sanitize_protein(c, strict: bool = True) -> Column:
    """struct<seq, warnings>; warnings are ordered as the checks run."""
    keep = AMINO_ACIDS if strict else AMINO_ACIDS + AMINO_EXTENDED
    full = F.upper(F.trim(_c(c)))
    raw = F.regexp_replace(full, r"\*+$", "")
    seq = F.regexp_replace(raw, f"[^{keep}]", "")
    warn = F.array_compact(
        F.array(
            F.when(full.endswith("*"), F.lit("stripped_trailing_stop_codon")),
            F.when(raw.rlike("[0-9]"), F.lit("removed_embedded_digits")),
            F.when(raw.rlike(rf"[^{keep}0-9\s]"), F.lit("removed_non_amino_acid_characters")),
            F.when(seq == "", F.lit("empty_after_sanitization")).when(
                F.length(seq) != F.length(raw),
                F.concat(
                    F.lit("length_changed_"),
                    F.length(raw).cast("string"),
                    F.lit("_to_"),
                    F.length(seq).cast("string"),
                ),
            ),
        )
    )
    empty = _c(c).isNull() | (full == "")
    return F.struct(
        F.when(empty, F.lit("")).otherwise(seq).alias("seq"),
        F.when(empty, F.array(F.lit("empty_sequence"))).otherwise(warn).alias("warnings"),
    )


def validate_protein(c, strict: bool = True) -> Column:
    """Status text: empty, invalid_characters:<sorted letters> or ok."""
    keep = AMINO_ACIDS if strict else AMINO_ACIDS + AMINO_EXTENDED
    bad = F.regexp_replace(F.upper(_c(c)), f"[{keep}]", "")
    letters = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(bad, F.lit("(?s)(.)"), F.lit(1)))), "")
    return (
        F.when(_c(c).isNull() | (_c(c) == ""), F.lit("empty"))
        .when(bad != "", F.concat(F.lit("invalid_characters:"), letters))
        .otherwise(F.lit("ok"))
    )


def _fraction(c, letters: str) -> Column:
    s = normalize_rna(c)
    n = F.length(s)
    return F.when(n > 0, (n - F.length(F.translate(s, letters, ""))) / n).otherwise(F.lit(0.0))


def gc_fraction(c) -> Column:
    return _fraction(c, "GC")


def au_fraction(c) -> Column:
    return _fraction(c, "AU")


def chars(c) -> Column:
    """Letters as an array; empty for the empty text."""
    return F.when(_c(c) == "", F.array().cast("array<string>")).otherwise(F.split(_c(c), ""))


def kmers(c, k: int, alphabet: str | None = None, distinct: bool = False) -> Column:
    """Overlapping k-mers in order, optionally only those inside ``alphabet``."""
    letter = f"[{alphabet}]" if alphabet else "."
    out = F.regexp_extract_all(_c(c), F.lit(f"(?s)(?=({letter}{{{k}}}))"), F.lit(1))
    return F.array_distinct(out) if distinct else out


def _counts(text: Column, words: Column) -> Column:
    """Sorted array<struct<token, n>> of overlapping occurrences: comparable, unlike a map."""
    return F.transform(
        F.array_sort(words),
        lambda t: F.struct(
            t.alias("token"), F.regexp_count(text, F.concat(F.lit("(?s)(?=\\Q"), t, F.lit("\\E)"))).alias("n")
        ),
    )


def _named(value: Column, body) -> Column:
    """body(value), the value being made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _present(tokens: dict) -> Column:
    """Sorted array<struct<token, n>> of the tokens that occur."""
    cells = [F.struct(F.lit(t).alias("token"), tokens[t].cast("int").alias("n")) for t in sorted(tokens)]
    return F.filter(F.array(*cells), lambda x: x["n"] > 0)


def _rna_only(s: Column) -> Column:
    return F.length(F.translate(s, RNA, "")) == 0


def _times(s: Column, t: str) -> Column:
    """Occurrences of a token that does not overlap itself."""
    return (F.length(s) - F.length(F.replace(s, F.lit(t), F.lit("")))) / len(t)


def nt_counts(c) -> Column:
    def count(s):
        return F.when(_rna_only(s), _present({a: _times(s, a) for a in RNA})).otherwise(_counts(s, F.array_distinct(chars(s))))

    return _named(normalize_rna(c), count)


def dinuc_counts(c, circular: bool = False) -> Column:
    def count(s):
        pairs = F.struct(*[_times(s, a).alias(a) for a in RNA], *[_times(s, a + b).alias(a + b) for a in RNA for b in RNA if a != b])

        def tokens(z):
            # a letter is followed by itself where no other letter and not the end follows
            same = {a + a: z[a] - sum((z[a + b] for b in RNA if b != a), F.lit(0)) - F.endswith(s, F.lit(a)).cast("int") for a in RNA}
            return _present({a + b: z[a + b] for a in RNA for b in RNA if a != b} | same)

        return F.when(_rna_only(s), _named(pairs, tokens)).otherwise(_counts(s, kmers(s, 2, distinct=True)))

    s = normalize_rna(c)
    return _named(s, lambda x: _named(F.when(F.length(x) >= 2, F.concat(x, F.left(x, F.lit(1)))).otherwise(x), count)) if circular else _named(s, count)


def same_composition(a, b) -> Column:
    return nt_counts(a) == nt_counts(b)


def same_dinucleotides(a, b) -> Column:
    return dinuc_counts(a) == dinuc_counts(b)


def hamming(a, b) -> Column:
    """Unequal lengths count as the longer length."""
    x, y = normalize_rna(a), normalize_rna(b)
    diff = F.size(F.filter(F.zip_with(chars(x), chars(y), lambda p, q: p != q), lambda d: d))
    return F.when(F.length(x) != F.length(y), F.greatest(F.length(x), F.length(y))).otherwise(diff)


def min_hamming(c, min_abs: int = 3, frac: float = 0.05) -> Column:
    n = F.length(normalize_rna(c))
    return F.when(n <= 0, F.lit(0)).otherwise(F.greatest(F.lit(min_abs), F.ceil(n * F.lit(frac)).cast("int")))


def passes_hamming(a, b, min_abs: int = 3, frac: float = 0.05) -> Column:
    return (normalize_rna(a) != normalize_rna(b)) & (hamming(a, b) >= min_hamming(a, min_abs, frac))


def _jaccard(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def rna_kmer_set(c, k: int) -> Column:
    s = normalize_rna(c)
    return F.when(s == "", F.array().cast("array<string>")).when(F.length(s) < k, F.array(s)).otherwise(
        kmers(s, k, distinct=True)
    )


def kmer_jaccard(a, b, k: int = 3) -> Column:
    x, y = rna_kmer_set(a, k), rna_kmer_set(b, k)
    both = (F.size(x) == 0) & (F.size(y) == 0)
    return F.when(both, F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(_jaccard(x, y))


def protein_kmer_jaccard(a, b, k: int = 3) -> Column:
    x, y = F.upper(_c(a)), F.upper(_c(b))
    short = (F.length(x) < k) | (F.length(y) < k)
    return F.when(short, (x == y).cast("double")).otherwise(
        _jaccard(kmers(x, k, distinct=True), kmers(y, k, distinct=True))
    )


def alphabet_kmers(alphabet: str, k: int) -> list[str]:
    """All words of length k in alphabet order, made by rule."""
    words = [""]
    for _ in range(k):
        words = [w + a for w in words for a in alphabet]
    return words


def triad_letters(c) -> Column:
    """Residue classes as the digits 0..6; unknown residues fall in class 0."""
    src = "".join(TRIAD_CLASSES)
    dst = "".join(str(i) * len(cls) for i, cls in enumerate(TRIAD_CLASSES))
    up = F.regexp_replace(F.upper(_c(c)), f"[^{src}]", "A")
    return F.translate(up, src, dst)


def one_hot(c, max_len: int, alphabet: str = RNA) -> Column:
    """max_len x |alphabet| array; unknown letters and padding are zero rows."""
    letters = F.slice(chars(_c(c)), 1, max_len)
    padded = F.concat(letters, F.array_repeat(F.lit("-"), F.greatest(F.lit(0), F.lit(max_len) - F.size(letters))))
    return F.transform(padded, lambda x: F.array(*[(x == a).cast("float") for a in alphabet]))


def window_offsets(c, win: int, step: int, suffix: bool = True) -> Column:
    """0-based window starts; the last full window is added when steps miss it."""
    n = F.length(_c(c))
    grid = F.sequence(F.lit(0), F.greatest(n - win, F.lit(0)), F.lit(step))
    tail = F.when((n - win) % step != 0, F.array(n - win)).otherwise(F.array().cast("array<int>"))
    full = F.concat(grid, tail) if suffix else grid
    return F.when(n <= win, F.array(F.lit(0))).otherwise(full)


def rna_windows(c, win: int, step: int, suffix: bool = True) -> Column:
    return F.transform(window_offsets(c, win, step, suffix), lambda o: F.substring(_c(c), o + 1, F.lit(win)))


def center_crop(c, n: int) -> Column:
    start = F.greatest(F.floor((F.length(_c(c)) - n) / 2), F.lit(0)).cast("int")
    return F.when(F.length(_c(c)) <= n, _c(c)).otherwise(F.substring(_c(c), start + 1, F.lit(n)))


def revcomp(c) -> Column:
    return F.reverse(F.translate(_c(c), "ACGT", "TGCA"))


def first_motif(c, ranked) -> Column:
    """struct<motif, pos>: first word of the ranked list found, 0-based; ('-', -1)."""
    found = F.filter(ranked, lambda k: F.instr(_c(c), k) > 0)
    hit = F.try_element_at(found, F.lit(1))
    return F.struct(
        F.coalesce(hit, F.lit("-")).alias("motif"),
        F.coalesce(F.instr(_c(c), hit) - 1, F.lit(-1)).alias("pos"),
    )


def kmer_cores(words, size: int = 5) -> Column:
    """Distinct core words of a k-mer list; shorter words stay whole."""
    return F.array_distinct(
        F.flatten(
            F.transform(words, lambda w: F.when(F.length(w) < size, F.array(w)).otherwise(kmers(w, size)))
        )
    )


def pwm_score(c, pwm, width: Column) -> Column:
    """Best window of the log-odds motif; null without a valid window.

    ``pwm`` is array<map<string,double>> of probabilities by position.
    Only windows made of ACGU count, and equal windows are scored once.
    """
    valid = F.array_distinct(
        F.regexp_extract_all(_c(c), F.concat(F.lit("(?=([ACGU]{"), width.cast("string"), F.lit("}))")), F.lit(1))
    )

    def score(w):
        terms = F.zip_with(
            chars(w),
            pwm,
            lambda b, col: F.ln(F.greatest(F.coalesce(F.try_element_at(col, b), F.lit(0.0)), F.lit(1e-6)) / 0.25),
        )
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)

    return F.array_max(F.transform(valid, score))


def identity_bin(x) -> Column:
    v = _c(x)
    return (
        F.when(v <= 0, "no_hit")
        .when(v < 0.3, "<30%")
        .when(v < 0.5, "30-50%")
        .when(v < 0.7, "50-70%")
        .when(v < 0.9, "70-90%")
        .otherwise(">=90%")
    )


def identity_bin_fine(x) -> Column:
    """Second scheme: left-closed bins at 0, .2, .3, .4, .5, .7."""
    v = _c(x)
    return (
        F.when(v < 0.2, "0-20%")
        .when(v < 0.3, "20-30%")
        .when(v < 0.4, "30-40%")
        .when(v < 0.5, "40-50%")
        .when(v < 0.7, "50-70%")
        .otherwise(">=70%")
    )


def outcome(y, p, thr: float = 0.5) -> Column:
    pred = _c(p) >= thr
    return (
        F.when(pred & (_c(y) == 1), "TP").when(pred, "FP").when(_c(y) == 1, "FN").otherwise("TN")
    )
