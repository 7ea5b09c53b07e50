"""Scalar functions on sequences, coordinates and records, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letter -> base of the derivation of sequences from plain text: the four bases in turn.
LETTER_BASES = ("ACGT" * 7)[:26]
#: Splice motifs, first two and last two intron bases -> (code, penalty) (fixed values).
MOTIFS = {"GTAG": (1, 0), "CTAC": (2, 0), "GCAG": (3, -4), "CTGC": (4, -4), "ATAC": (5, -8), "GTAT": (6, -8)}
NO_MOTIF = (0, -8)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- sequences -----------------------------------------------------------------------------------------------------------------

def dna(text: Column | str, gap: str = "") -> Column:
    """A sequence from plain text: ASCII letters become bases, stretches of anything else become `gap`."""
    kept = F.translate(F.upper(F.regexp_replace(_c(text), "[^A-Za-z]+", "#")), ALPHABET, LETTER_BASES)
    return F.regexp_replace(kept, "#", gap)


def clean_sequence(line: Column | str) -> Column:
    """A sequence line without white space, in upper case."""
    return F.upper(F.regexp_replace(_c(line), r"\s", ""))


def header_name(header: Column | str) -> Column:
    """First token of a header, up to a blank or tab, without a carriage return."""
    return F.split(F.regexp_replace(_c(header), "\r", ""), "[ \t]")[0]


def base_code(base: Column | str, other: int = -1) -> Column:
    """A 0, C 1, G 2, T 3, anything else `other`."""
    at = F.instr(F.lit("ACGT"), _c(base))
    return F.when((at > 0) & (F.length(_c(base)) == 1), at - 1).otherwise(other)


def complement(base: Column | str) -> Column:
    return F.translate(_c(base), "ACGT", "TGCA")


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; N, # and other characters stay."""
    return F.reverse(complement(_c(seq)))


def revcomp_read(seq: Column | str) -> Column:
    """Reverse complement of a read: all but A, C, G, T and # becomes N."""
    return revcomp(F.regexp_replace(_c(seq), "[^ACGT#]", "N"))


def revcomp_mate(seq: Column | str) -> Column:
    """Reverse complement of a mate: all but A, C, G, T becomes N."""
    return revcomp(F.regexp_replace(_c(seq), "[^ACGT]", "N"))


def kmer_code(kmer: Column | str, k: int) -> Column:
    """Two bits a base, first base highest; -1 if shorter than k or with another character in its first k (k <= 31)."""
    s = _c(kmer)
    head = F.substring(s, 1, k)
    return F.when(head.rlike(f"^[ACGT]{{{k}}}$"), F.conv(F.translate(head, "ACGT", "0123"), 4, 10).cast("long")).otherwise(F.lit(-1).cast("long"))


def kmer_code_partial(kmer: Column | str, k: int) -> Column:
    """(hash, length): the code with everything from the first bad base on read as T, and the number of good bases before it."""
    s = F.substring(_c(kmer), 1, k)
    good = F.regexp_extract(s, "^[ACGT]*", 0)
    filled = F.rpad(good, k, "T")
    return F.struct(F.conv(F.translate(filled, "ACGT", "0123"), 4, 10).cast("long").alias("hash"), F.length(good).alias("length"))


def suffix_key(seq: Column | str) -> Column:
    """Sort key in which N and # are larger than all bases."""
    return F.translate(_c(seq), "N#", "~~")


def padded_length(length: Column | str, bin_bits: int, last: Column) -> Column:
    """Length after padding: the next multiple of 2**bin_bits, one base of padding at least unless it's the last."""
    size = 1 << bin_bits
    n = _c(length)
    return F.when(last, F.ceil(n / size) * size).otherwise((F.floor(n / size) + 1) * size).cast("long")


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix of two strings: binary search over substring equality."""
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))  # a string has fewer than 2**31 characters

    def search(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        size = F.least(F.length(x), F.length(y))

        def grow(got: Column, step: Column) -> Column:
            n = got + step
            return F.when((n <= size) & (F.substr(x, F.lit(1), n) == F.substr(y, F.lit(1), n)), n).otherwise(got)

        return F.aggregate(steps, F.lit(0), grow)

    # the array of one evaluates both strings once, not at every step
    return F.transform(F.array(F.struct(_c(a).alias("x"), _c(b).alias("y"))), search)[0]


def matches(a: Column | str, b: Column | str) -> Column:
    """(matched, unmatched) of two equally long slices; places with N in either count for neither."""
    x, y = (F.filter(F.split(_c(c), ""), lambda p: p != "") for c in (a, b))
    same = F.zip_with(x, y, lambda p, q: F.when((p == "N") | (q == "N"), F.lit(None)).otherwise(p == q))
    return F.struct(F.size(F.filter(same, lambda v: v)).alias("matched"), F.size(F.filter(same, lambda v: ~v)).alias("unmatched"))


# -- coordinates ---------------------------------------------------------------------------------------------------------------

def bin_of(pos: Column | str, bits: int = 16) -> Column:
    return F.shiftright(_c(pos).cast("long"), bits)


def global_pos(start: Column | str, chr_start: Column | str) -> Column:
    """Global 0-based place of a 1-based place on a chromosome."""
    return _c(start) + _c(chr_start) - 1


def local_pos(pos: Column | str, chr_start: Column | str) -> Column:
    """1-based place on a chromosome of a global 0-based one."""
    return _c(pos) - _c(chr_start) + 1


def strand_project(pos: Column, length: Column, read_start: Column, read_length: Column, direction: Column, genome_length: Column) -> Column:
    """(genome_start, read_start, strand) on the forward strand of a hit in genome + reverse complement."""
    back = pos >= genome_length
    return F.struct(
        F.when(back, 2 * genome_length - pos - length).otherwise(pos).alias("genome_start"),
        F.when(back, read_length - read_start - length).otherwise(read_start).alias("read_start"),
        F.when(back, 1 - direction).otherwise(direction).alias("strand"),
    )


def strand_code(strand: Column | str) -> Column:
    """+ 1, - 2, other 0."""
    return F.when(_c(strand) == "+", 1).when(_c(strand) == "-", 2).otherwise(0)


def strand_char(code: Column | str) -> Column:
    return F.when(_c(code) == 1, "+").when(_c(code) == 2, "-").otherwise(".")


# -- splicing ------------------------------------------------------------------------------------------------------------------

def _motif(first2: Column | str, last2: Column | str, part: int) -> Column:
    both = F.concat(_c(first2), _c(last2))
    out = None
    for m, v in MOTIFS.items():
        out = F.when(both == m, v[part]) if out is None else out.when(both == m, v[part])
    return out.otherwise(NO_MOTIF[part])


def splice_motif(first2: Column | str, last2: Column | str) -> Column:
    """Motif code of an intron by its first and last two bases."""
    return _motif(first2, last2, 0)


def splice_penalty(first2: Column | str, last2: Column | str) -> Column:
    return _motif(first2, last2, 1)


def motif_strand(motif: Column | str) -> Column:
    """Strand code of a motif: odd codes 1, even ones 2, none 0."""
    return F.when(_c(motif) > 0, 2 - _c(motif) % 2).otherwise(0)


def length_penalty(span: Column | str, scale: float = 0.25, shift: float = 0.5) -> Column:
    """ceil(-scale * log2(span) - shift), as a whole number."""
    return F.ceil(F.log2(_c(span).cast("double")) * -scale - shift).cast("long")


# -- annotation attributes -----------------------------------------------------------------------------------------------------

def attribute(attrs: Column | str, *names: str) -> Column:
    """Value of an attribute, quoted or not; of several names the last that is there wins; null if none is."""
    found = [F.nullif(F.regexp_extract(_c(attrs), rf'(?:^|[; =\t"]){n}[ =\t"]+([^; =\t"]+)', 1), F.lit("")) for n in reversed(names)]
    return F.coalesce(*found)


# -- alignment records ---------------------------------------------------------------------------------------------------------

def min_share(length: Column | str, share: float = 0.66) -> Column:
    """Whole part of a share of the read's length."""
    return (_c(length) * F.lit(share)).cast("int")


def mapq(hits: Column | str) -> Column:
    """255 for one place, 3 for two, 1 for more."""
    return F.when(_c(hits) == 1, 255).when(_c(hits) == 2, 3).otherwise(1)


def sam_flag(paired: Column, strand: Column, mate: Column) -> Column:
    """FLAG of a record: single 0 or 16; pairs 99/147 or 163/83 by the strand of the pair and the mate's number."""
    forward = strand == 0
    return F.when(~paired, F.when(forward, 0).otherwise(16)).when(mate == 1, F.when(forward, 99).otherwise(83)).otherwise(F.when(forward, 147).otherwise(163))


def cigar(read_length: Column, exons: Column, junctions: Column) -> Column:
    """CIGAR from exons (start, length, read_start) and the gaps between them (type, length): N for introns (type >= 0), D (-1), I (-2)."""
    last = F.element_at(exons, -1)
    op = lambda t: F.when(t >= 0, "N").when(t == -1, "D").otherwise("I")
    body = F.transform(exons, lambda e, i: F.concat(
        e["length"].cast("string"), F.lit("M"),
        F.when(i < F.size(junctions), F.concat(F.get(junctions, i)["length"].cast("string"), op(F.get(junctions, i)["type"]))).otherwise(""),
    ))
    head, tail = exons[0]["read_start"], read_length - last["read_start"] - last["length"]
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(clip(head), F.array_join(body, ""), clip(tail))
