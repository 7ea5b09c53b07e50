"""DuckDB SQL for the queries of `catalog`, from shared parts."""
from __future__ import annotations

from ..functions.scalar import ALPHABET, LETTER_BASES, MOTIFS, NO_MOTIF
from .catalog import K, PAIR_K, SHORT_K


def dna(c: str, gap: str = "") -> str:
    return f"replace(translate(upper(regexp_replace({c}, '[^A-Za-z]+', '#', 'g')), '{ALPHABET}', '{LETTER_BASES}'), '#', '{gap}')"


def rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def code(s: str, k: int) -> str:
    """k-mer code of a whole ACGT string of k bases."""
    return "(" + " + ".join(f"(strpos('ACGT', substr({s}, {i + 1}, 1)) - 1)::BIGINT * {4 ** (k - 1 - i)}" for i in range(k)) + ")"


def motif(x: str, part: int) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{m}' THEN {v[part]}" for m, v in MOTIFS.items()) + f" ELSE {NO_MOTIF[part]} END"


def lcp_sql(a: str, b: str, most: int) -> str:
    return f"coalesce((SELECT min(i) - 1 FROM unnest(range(1, {most} + 2)) AS u(i) WHERE i > least(length({a}), length({b})) OR substr({a}, i, 1) <> substr({b}, i, 1)), 0)"


G = f"g AS (SELECT doc_id AS chr_idx, {dna('text')} AS seq FROM documents)"
R = f"r AS (SELECT item_id AS read_idx, {dna('text')} AS seq FROM benchmark)"
O = f"o AS (SELECT read_idx, 0 AS direction, length(seq) AS n, seq FROM r UNION ALL SELECT read_idx, 1, length(seq), {rc('seq')} FROM r)"  # noqa: E741
QN = f"q AS (SELECT item_id, {dna('text', 'N')} AS seq FROM benchmark)"


def gk(k: int) -> str:
    return f"gk AS (SELECT chr_idx, pos, substr(seq, pos + 1, {k}) AS kmer FROM g, unnest(range(0, length(seq) - {k} + 1)) AS u(pos))"


def rk(k: int) -> str:
    return f"rk AS (SELECT read_idx, direction, n, s, substr(seq, s + 1, {k}) AS kmer FROM o, unnest(range(0, length(seq) - {k} + 1)) AS u(s))"


def hits(k: int) -> list[str]:
    return [
        G, R, O, rk(k), gk(k), "gs AS (SELECT gk.* FROM gk SEMI JOIN rk USING (kmer))", "rare AS (SELECT kmer FROM gs GROUP BY kmer HAVING count(*) <= 10000)",
        "hits AS (SELECT read_idx, direction, n, s, chr_idx, pos FROM rk JOIN gs USING (kmer) JOIN rare USING (kmer))",
    ]


def mems(k: int = K) -> list[str]:
    return hits(k) + [
        "isl AS (SELECT *, pos - s AS diag, s - row_number() OVER (PARTITION BY read_idx, direction, chr_idx, pos - s ORDER BY s) AS island FROM hits)",
        f"mem AS (SELECT read_idx, direction, n, chr_idx, min(s) AS read_start, max(s) - min(s) + {k} AS length, min(s) + diag AS pos FROM isl GROUP BY read_idx, direction, n, chr_idx, diag, island)",
    ]


def sql(parts: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def big(*names: str) -> str:
    return ", ".join(f"{n}::BIGINT AS {n}" for n in names)


GROUP = "read_idx, direction, chr_idx"
SEEDS = ["seeds AS (SELECT *, count(*) OVER (PARTITION BY read_idx, direction, read_start, length) AS rep FROM mem)", "seed AS (SELECT *, rep <= 50 AS is_anchor FROM seeds)"]


def sessions(bits: int = 6) -> list[str]:
    return [
        f"bins AS (SELECT {GROUP}, pos >> {bits} AS bin, count(*) AS n FROM seed WHERE is_anchor GROUP BY ALL)",
        f"gaps AS (SELECT *, bin - lag(bin) OVER (PARTITION BY {GROUP} ORDER BY bin) AS gap FROM bins)",
        f"numbered AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 9 THEN 1 ELSE 0 END) OVER (PARTITION BY {GROUP} ORDER BY bin) AS window_id FROM gaps)",
        f"win AS (SELECT {GROUP}, window_id, min(bin) AS start_bin, max(bin) AS end_bin, sum(n) AS num_anchors FROM numbered GROUP BY {GROUP}, window_id)",
    ]


FLANK = f"flanked AS (SELECT {GROUP}, window_id, greatest(start_bin - 4, 0) AS start_bin, least(end_bin + 4, greatest(length(g.seq) - 1, 0) >> 6) AS end_bin, num_anchors FROM win JOIN g USING (chr_idx))"


def assigned(source: str = "flanked", bits: int = 6) -> list[str]:
    return [
        f"owner AS (SELECT {GROUP}, bin, max(window_id) AS window_id FROM {source}, unnest(range(start_bin, end_bin + 1)) AS u(bin) GROUP BY ALL)",
        f"asg AS (SELECT seed.*, window_id FROM seed JOIN owner ON owner.read_idx = seed.read_idx AND owner.direction = seed.direction AND owner.chr_idx = seed.chr_idx AND owner.bin = seed.pos >> {bits} WHERE rep <= 10000)",
    ]


W = f"{GROUP}, window_id"
SUBSUME = [
    f"reached AS (SELECT *, pos - read_start AS diag, max(read_start + length) OVER (PARTITION BY {W}, pos - read_start ORDER BY read_start, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM asg)",
    f"islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach <= read_start THEN 1 ELSE 0 END) OVER (PARTITION BY {W}, diag ORDER BY read_start, length) AS isle FROM reached)",
    f"sub AS (SELECT * FROM islands QUALIFY row_number() OVER (PARTITION BY {W}, diag, isle ORDER BY length DESC, read_start) = 1)",
]
TOP = [
    f"best AS (SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY {W} ORDER BY is_anchor DESC, length DESC, read_start, pos) <= 50)",
    f"kept AS (SELECT *, row_number() OVER (PARTITION BY {W} ORDER BY read_start, pos, length) AS ordinal FROM best)",
]
SEEDED = [*mems(), *SEEDS, *sessions(), FLANK, *assigned()]
KEPT = [*SEEDED, *SUBSUME, *TOP]
PAIRS = [*mems(PAIR_K), *SEEDS, *sessions(), FLANK, *assigned(), *SUBSUME, *TOP, f"pairs AS (SELECT {', '.join('a.' + c.strip() for c in W.split(','))}, a.ordinal AS i, b.ordinal AS j, a.read_start AS a_read, a.pos AS a_pos, a.length AS a_length, b.read_start AS b_read, b.pos AS b_pos, b.length AS b_length FROM kept a JOIN kept b USING ({W}) WHERE a.ordinal < b.ordinal)"]

CLIPPED = "(CASE WHEN read_start > 0 THEN read_start || 'S' ELSE '' END) || matched || 'M' || (CASE WHEN read_length - read_start - matched > 0 THEN (read_length - read_start - matched) || 'S' ELSE '' END)"
SELECTED = [
    *mems(),
    "cand AS (SELECT read_idx, n AS read_length, length - (n - length) // 20 AS score, length AS matched, chr_idx, pos AS genome_start, pos + length AS genome_end, direction AS strand, read_start FROM mem)",
    f"good AS (SELECT *, {CLIPPED} AS cigar FROM cand WHERE score >= floor(read_length * 0.66::DOUBLE) AND matched >= floor(read_length * 0.66::DOUBLE))",
    "once AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY read_idx, chr_idx, genome_start, genome_end, strand, cigar ORDER BY score DESC, matched DESC) = 1)",
    "stored AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY read_idx ORDER BY score DESC, matched DESC, chr_idx, genome_start, genome_end, strand, cigar) <= 100)",
    "near AS (SELECT * FROM stored QUALIFY score >= max(score) OVER (PARTITION BY read_idx) - 1)",
    "sel AS (SELECT *, count(*) OVER (PARTITION BY read_idx) AS hits FROM near)",
    "sel2 AS (SELECT *, CASE WHEN hits > 10 THEN 'TOO_MANY' ELSE 'SUCCESS' END AS status FROM sel)",
]
STATUS = [
    *SELECTED, "seeded AS (SELECT DISTINCT read_idx FROM mem)", "per AS (SELECT read_idx, max(status) AS s, max(hits) AS hits FROM sel2 GROUP BY read_idx)",
    "status AS (SELECT r.read_idx, coalesce(s, CASE WHEN seeded.read_idx IS NOT NULL THEN 'NO_GOOD_ALIGNMENT' END, 'NO_ANCHOR') AS status, coalesce(hits, 0)::BIGINT AS hits FROM r LEFT JOIN per ON per.read_idx = r.read_idx LEFT JOIN seeded ON seeded.read_idx = r.read_idx)",
]
MAPQ = "(CASE hits WHEN 1 THEN 255 WHEN 2 THEN 3 ELSE 1 END)"

LAYOUT = [
    G, "sized AS (SELECT chr_idx, 'doc' || chr_idx AS name, length(seq) AS length, (length(seq) // 1024 + 1) * 1024 AS padded FROM g)",
    "chrs AS (SELECT chr_idx, name, sum(padded) OVER (ORDER BY chr_idx) - padded AS start, length, padded FROM sized)",
]
POSITIONS = "p AS (SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey * 7919 + l_orderkey * 13 AS pos FROM lineitem)"

INTRONS = [
    G, "i AS (SELECT chr_idx, seq, j, 10 + (chr_idx * 7 + j * 1009) % (length(seq) // 2 - 20) AS s, length(seq) // 2 + 10 + (chr_idx * 5 + j * 2003) % (length(seq) // 2 - 20) AS e FROM g, unnest(range(0, 5)) AS u(j) WHERE length(seq) >= 120)",
    f"sh AS (SELECT *, {lcp_sql('reverse(substr(seq, 1, s))', 'reverse(substr(seq, 1, e + 1))', 255)} AS shift_left, {lcp_sql('substr(seq, s + 1, 255)', 'substr(seq, e + 2, 255)', 255)} AS shift_right FROM i)",
]
ANNOTATED = [*INTRONS, f"ann AS (SELECT s AS start, e AS \"end\", chr_idx % 3 AS strand, {motif('substr(seq, s + 1, 2) || substr(seq, e, 2)', 0)} AS motif, 10 * (1 + j % 2) AS priority, shift_left, shift_right, chr_idx * 5 + j AS ordinal FROM sh)"]
DEDUP1 = [*ANNOTATED, "dd AS (SELECT * FROM ann QUALIFY row_number() OVER (PARTITION BY strand, start - shift_left, \"end\" - shift_left ORDER BY priority DESC, motif > 0 DESC, shift_left, ordinal) = 1)"]
DATABASE = [
    *ANNOTATED[:-1], ANNOTATED[-1].replace("ann AS (SELECT ", "ann AS (SELECT chr_idx, seq, "),
    "d1 AS (SELECT * FROM ann QUALIFY row_number() OVER (PARTITION BY chr_idx, strand, start - shift_left, \"end\" - shift_left ORDER BY priority DESC, motif > 0 DESC, shift_left, start) = 1)",
    "db AS (SELECT chr_idx, start, \"end\", strand, motif, shift_left, shift_right, least(start, 30) AS donor, substr(seq, greatest(start - 30, 0) + 1, least(start, 30)) || substr(seq, \"end\" + 2, 30) AS sj_seq FROM d1 QUALIFY row_number() OVER (PARTITION BY chr_idx, start, \"end\" ORDER BY strand > 0 DESC, priority DESC) = 1)",
]
PARTS = [
    *DATABASE, "r AS (SELECT chr_idx * 5 + j AS read_idx, substr(seq, greatest(s - 15, 0) + 1, least(s, 15)) || substr(seq, e + 2, 25) AS seq FROM i)", O,
    f"rk AS (SELECT read_idx, direction, n, s, substr(seq, s + 1, {K}) AS kmer FROM o, unnest(range(0, n - {K} + 1)) AS u(s))",
    f"jk AS (SELECT db.*, p, substr(sj_seq, p + 1, {K}) AS kmer FROM db, unnest(range(0, length(sj_seq) - {K} + 1)) AS u(p))",
    "rare AS (SELECT kmer FROM jk GROUP BY kmer HAVING count(*) <= 10000)",
    "jh AS (SELECT *, s - row_number() OVER (PARTITION BY read_idx, direction, chr_idx, start, \"end\", p - s ORDER BY s) AS island FROM rk JOIN jk USING (kmer) SEMI JOIN rare USING (kmer))",
    f"jm AS (SELECT read_idx, direction, chr_idx, start, \"end\", motif, shift_left, shift_right, donor, min(s) AS read_start, max(s) - min(s) + {K} AS length, min(p) AS pos FROM jh GROUP BY read_idx, direction, chr_idx, start, \"end\", motif, shift_left, shift_right, donor, p - s, island)",
    "jx AS (SELECT *, donor - pos AS before FROM jm WHERE pos < donor AND pos + length > donor)",
    "jp AS (SELECT read_idx, direction, chr_idx, read_start, before AS length, start - before AS pos, CASE WHEN motif = 0 THEN shift_left ELSE -1 END AS repeat FROM jx UNION ALL SELECT read_idx, direction, chr_idx, read_start + before, length - before, \"end\" + 1, CASE WHEN motif = 0 THEN shift_right ELSE -1 END FROM jx)",
]

EXONS = [
    "l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS size, l_returnflag AS flag FROM lineitem)",
    "ex0 AS (SELECT *, sum(size + l_suppkey % 7) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + l_orderkey % 50 AS \"end\", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM l)",
    "ex AS (SELECT l_orderkey AS transcript, line, 'doc' || (l_orderkey % 1500) AS chr, \"end\" - size + 1 AS start, \"end\", CASE flag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS strand, l_partkey % 100 AS gene FROM ex0)",
]
INTRON = [*EXONS, "prev AS (SELECT *, lag(\"end\") OVER (PARTITION BY transcript ORDER BY start, \"end\") AS p FROM ex)", "sj AS (SELECT transcript, p + 1 AS sj_start, start - 1 AS sj_end, strand, gene FROM prev WHERE start > p + 1)"]

MMP = [
    *mems(SHORT_K),
    "ends AS (SELECT read_idx, direction, read_start AS a, read_start + length AS b FROM mem UNION ALL SELECT read_idx, 1 - direction, n - read_start - length, n - read_start FROM mem)",
    f"lens AS (SELECT read_idx, direction, s, b - s AS length, count(*) AS rep FROM ends, unnest(range(a, b - {SHORT_K} + 1)) AS u(s) GROUP BY ALL)",
    "top AS (SELECT * FROM lens QUALIFY row_number() OVER (PARTITION BY read_idx, direction, s ORDER BY length DESC) = 1)",
    f"pl AS (SELECT read_idx, direction, n, s, substr(seq, s + 1, {SHORT_K}) AS kmer FROM o, unnest(range(0, length(seq))) AS u(s))",
    f"qs AS (SELECT DISTINCT kmer FROM pl)",
    f"two AS (SELECT seq FROM g UNION ALL SELECT {rc('seq')} FROM g)",
    f"gs2 AS (SELECT DISTINCT substr(seq, p + 1, {SHORT_K}) AS kmer FROM two, unnest(range(0, length(seq))) AS u(p))",
    f"gp AS (SELECT DISTINCT substr(kmer, 1, l) AS p FROM gs2, unnest(range(1, {SHORT_K} + 1)) AS u(l) WHERE l <= length(kmer))",
    f"qp AS (SELECT kmer, l, substr(kmer, 1, l) AS p FROM qs, unnest(range(1, {SHORT_K} + 1)) AS u(l) WHERE l <= length(kmer))",
    "short AS (SELECT qs.kmer, coalesce(max(l), 0) AS short FROM qs LEFT JOIN (SELECT kmer, l FROM qp SEMI JOIN gp USING (p)) x ON x.kmer = qs.kmer GROUP BY qs.kmer)",
    "mmp AS (SELECT pl.read_idx, pl.direction, pl.n, pl.s, coalesce(top.length, short) AS length, rep FROM pl LEFT JOIN top USING (read_idx, direction, s) LEFT JOIN short USING (kmer))",
]

_SUFFIX = "sfx AS (SELECT item_id, pos, substr(seq, pos + 1, 400) AS suffix FROM q, unnest(range(0, length(seq))) AS u(pos) WHERE substr(seq, pos + 1, 1) <> 'N')"
_RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY translate(suffix, 'N#', '~~') || chr(127), item_id, pos) - 1 AS rank FROM sfx)"

EXTEND = [
    f"a AS (SELECT item_id, {dna('text', 'N')} AS r FROM benchmark)",
    f"b AS (SELECT item_id - 1 AS item_id, {dna('text', 'N')} || '#' || {dna('text')} AS gs FROM benchmark)",
    "s AS (SELECT item_id, regexp_extract(r, '^[^#]*') AS r, regexp_extract(gs, '^[^#]*') AS gs FROM a JOIN b USING (item_id))",
    "w AS (SELECT item_id, p, substr(r, p, 1) AS x, substr(gs, p, 1) AS y FROM s, unnest(range(1, least(length(r), length(gs)) + 1)) AS u(p))",
    "c AS (SELECT item_id, p, sum((x <> 'N' AND y <> 'N' AND x = y)::INT) OVER z AS hit, sum((x <> 'N' AND y <> 'N' AND x <> y)::INT) OVER z AS miss FROM w WINDOW z AS (PARTITION BY item_id ORDER BY p))",
    "bud AS (SELECT item_id, m FROM s, unnest(range(0, 11)) AS u(m))",
    "cc AS (SELECT bud.item_id, m, p, hit, miss FROM bud JOIN c ON c.item_id = bud.item_id AND miss <= m WHERE hit > miss)",
    "top AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY item_id, m ORDER BY hit - miss DESC, p) = 1)",
]

ORACLES = {
    "dna_derive": sql([G], "SELECT chr_idx, length(seq)::BIGINT AS length, md5(seq) AS seq_md5 FROM g"),
    "revcomp": sql([QN], f"SELECT item_id, {rc('seq')} AS genome_rc, {rc(chr(40) + 'seq || ' + chr(39) + '#' + chr(39) + ' || seq' + chr(41))} AS read_rc, {rc('seq')} AS mate_rc, reverse(seq) AS quality_rc FROM q"),
    "base_composition": sql([G], "SELECT chr_idx, " + ", ".join(f"(length(seq) - length(replace(seq, '{b}', '')))::BIGINT AS n_{b.lower()}" for b in "ACGT") + " FROM g"),
    "kmer_encode": sql([QN, f"k AS (SELECT item_id, pos, substr(seq, pos + 1, {SHORT_K}) AS kmer FROM q, unnest(range(0, length(seq))) AS u(pos))"], f"SELECT item_id, pos::BIGINT AS pos, CASE WHEN length(kmer) = {SHORT_K} AND strpos(kmer, 'N') = 0 THEN {code('kmer', SHORT_K)} ELSE -1 END AS code, (strpos('ACGT', kmer[1]) - 1)::BIGINT AS base, (CASE WHEN kmer[1] = 'N' THEN 4 ELSE strpos('ACGT', kmer[1]) - 1 END)::BIGINT AS sort_base FROM k"),
    "kmer_encode_partial": sql([QN, f"k AS (SELECT item_id, pos, rpad(split_part(substr(seq, pos + 1, {SHORT_K}), 'N', 1), {SHORT_K}, 'T') AS kmer, length(split_part(substr(seq, pos + 1, {SHORT_K}), 'N', 1)) AS good FROM q, unnest(range(0, length(seq) - {SHORT_K} + 1)) AS u(pos))"], f"SELECT item_id, pos::BIGINT AS pos, {code('kmer', SHORT_K)} AS hash, good::BIGINT AS length FROM k"),
    "header_token": "SELECT p_partkey, regexp_extract(p_name, '^[^ \\t]*') AS name, upper(regexp_replace(p_type, '\\s', '', 'g')) AS clean FROM part",
    "attr_extract": "SELECT event_id, event_type AS gene_id, 't' || user_id AS transcript_id, coalesce(nullif(regexp_extract(props, '\"k\":\\s*(\\d+)', 1), ''), 'MissingGeneType') AS gene_type, event_type AS gene_name FROM events",
    "pad_layout": sql(LAYOUT, f"SELECT {big('chr_idx')}, name, {big('start', 'length')}, (CASE WHEN chr_idx = (SELECT max(chr_idx) FROM chrs) THEN ceil(length / 1024.0) * 1024 ELSE padded END)::BIGINT AS padded FROM chrs"),
    "chromosome_of_pos": sql([*LAYOUT, POSITIONS, "x AS (SELECT chr_idx, pos, pos - start AS off FROM p ASOF JOIN chrs ON p.pos >= chrs.start)"], "SELECT chr_idx, count(*)::BIGINT AS n, min(pos)::BIGINT AS first_pos, sum(off)::BIGINT AS offsets FROM x GROUP BY chr_idx"),
    "strand_project": sql(["q AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey AS pos, l_quantity::BIGINT AS len, l_suppkey % 50 AS rs, l_linenumber % 2 AS d FROM lineitem)"], "SELECT l_orderkey, line, (CASE WHEN pos >= 1000 THEN 2000 - pos - len ELSE pos END)::BIGINT AS genome_start, (CASE WHEN pos >= 1000 THEN 200 - rs - len ELSE rs END)::BIGINT AS read_start, (CASE WHEN pos >= 1000 THEN 1 - d ELSE d END)::BIGINT AS strand FROM q"),
    "two_strand_union": sql([G, f"b AS (SELECT 0 AS strand, seq FROM g UNION ALL SELECT 1, {rc('seq')} FROM g)"], "SELECT strand::BIGINT AS strand, count(*)::BIGINT AS n, sum(length(seq))::BIGINT AS bases, min(md5(seq)) AS least_md5, max(md5(seq)) AS most_md5 FROM b GROUP BY strand"),
    "read_split_runs": sql(
        [f"q AS (SELECT item_id AS read_idx, {dna(chr(40) + 'regexp_replace(text, ' + chr(39) + '[,.]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')' + chr(41))} || 'N' || {dna('text')} || '#' || {dna('reverse(text)', 'N')} AS seq FROM benchmark)",
         "c AS (SELECT read_idx, p, substr(seq, p + 1, 1) AS b FROM q, unnest(range(0, length(seq))) AS u(p))", "f AS (SELECT *, sum((b = '#')::INT) OVER (PARTITION BY read_idx ORDER BY p) AS fragment FROM c)",
         "isl AS (SELECT *, p - row_number() OVER (PARTITION BY read_idx ORDER BY p) AS island FROM f WHERE b NOT IN ('N', '#'))"],
        "SELECT read_idx, min(fragment)::BIGINT AS fragment, min(p)::BIGINT AS read_start, count(*)::BIGINT AS length FROM isl GROUP BY read_idx, island HAVING count(*) >= 20"),
    "kmer_index": sql([G, gk(SHORT_K), "c AS (SELECT kmer, count(*) AS n FROM gk GROUP BY kmer)"], f"SELECT kmer, {code('kmer', SHORT_K)} AS code, (sum(n) OVER (ORDER BY kmer) - n)::BIGINT AS first_rank, n::BIGINT AS count FROM c"),
    "kmer_prefix_presence": sql([p for p in MMP if p.split(" ")[0] in ("g", "r", "o", "pl", "qs", "two", "gs2", "gp", "qp", "short")], "SELECT kmer, short::BIGINT AS length FROM short"),
    "kmer_sample_points": sql([G, gk(12), "x AS (SELECT substr(kmer, 1, 6) AS kmer, substr(kmer, 7, 6) AS next_kmer, chr_idx, pos FROM gk)", "n AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS n, row_number() OVER (PARTITION BY kmer ORDER BY next_kmer, chr_idx, pos) - 1 AS rn FROM x)"], "SELECT kmer, (rn // (n // 16))::BIGINT AS point, next_kmer FROM n WHERE n > 16 AND rn % (n // 16) = 0 AND rn // (n // 16) < 16"),
    "kmer_ffill_bounds": sql([G, gk(7), f"c AS (SELECT {code('kmer', 7)} AS code, count(*) AS n FROM gk GROUP BY kmer)", "a AS (SELECT range AS code FROM range(16384))"], "SELECT a.code::BIGINT AS code, (sum(coalesce(n, 0)) OVER (ORDER BY a.code) - coalesce(n, 0))::BIGINT AS first_rank, coalesce(n, 0)::BIGINT AS count FROM a LEFT JOIN c ON c.code = a.code"),
    "suffix_rank": sql([QN, _SUFFIX, _RANKED], f"SELECT {big('rank')}, item_id, {big('pos')} FROM ranked"),
    "lcp": sql([QN, _SUFFIX, _RANKED, "n AS (SELECT rank, suffix, lag(suffix) OVER (ORDER BY rank) AS prev FROM ranked)"], f"SELECT {big('rank')}, (CASE WHEN prev IS NULL THEN 0 ELSE {lcp_sql('suffix', 'prev', 255)} END)::BIGINT AS lcp FROM n"),
    "suffix_merge": sql([QN, _SUFFIX, "m AS (SELECT item_id % 2 AS source, item_id, pos, row_number() OVER (ORDER BY translate(suffix, 'N#', '~~') || chr(127), item_id % 2, item_id, pos) - 1 AS rank FROM sfx)"], "SELECT source::BIGINT AS source, item_id, pos::BIGINT AS pos, rank::BIGINT AS rank, (CASE WHEN source = 1 THEN sum(1 - source) OVER (ORDER BY rank) END)::BIGINT AS insert_rank FROM m"),
    "seed_hits": sql(hits(K), "SELECT read_idx, direction::BIGINT AS direction, s::BIGINT AS s, count(*)::BIGINT AS rep, min(chr_idx)::BIGINT AS first_chr, sum(pos)::BIGINT AS pos_sum FROM hits GROUP BY read_idx, direction, s"),
    "stored_seed_hits": sql(hits(K), "SELECT read_idx, direction::BIGINT AS direction, s::BIGINT AS s, count(*)::BIGINT AS rep, min(chr_idx)::BIGINT AS first_chr, sum(pos)::BIGINT AS pos_sum FROM hits GROUP BY read_idx, direction, s"),
    "short_tail_prefix_range": sql([G, R, gk(8), "t AS (SELECT read_idx, right(seq, 8) AS tail FROM r)", "s AS (SELECT read_idx, l, substr(tail, 1, l) AS p FROM t, unnest(range(1, length(tail) + 1)) AS u(l))", "c AS (SELECT substr(kmer, 1, l) AS p, count(*) AS n FROM gk, unnest(range(1, 9)) AS u(l) GROUP BY 1)"], "SELECT read_idx, l::BIGINT AS length, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN c USING (p)"),
    "mem_islands": sql(mems(), f"SELECT {big('read_idx', 'direction', 'n', 'chr_idx', 'read_start', 'length', 'pos')} FROM mem"),
    "mmp_per_position": sql(MMP, f"SELECT {big('read_idx', 'direction', 's', 'length', 'rep')} FROM mmp"),
    "seed_chain": sql(
        [*MMP, "st AS (SELECT read_idx, direction, n, x * (n // (1 + n // 50)) AS s FROM o, unnest(range(0, 1 + n // 50)) AS u(x))",
         "reach AS (SELECT read_idx, direction, n, s FROM st WHERE n - s >= 6 UNION SELECT reach.read_idx, reach.direction, reach.n, reach.s + greatest(mmp.length, 1) FROM reach JOIN mmp USING (read_idx, direction, s) WHERE reach.n - reach.s - greatest(mmp.length, 1) >= 6)",
         "fw AS (SELECT read_idx, min(direction) AS fw FROM mmp WHERE s = 0 AND length = n GROUP BY read_idx)",
         "ch AS (SELECT DISTINCT reach.read_idx, reach.direction, reach.s, length, rep FROM reach JOIN mmp USING (read_idx, direction, s) LEFT JOIN fw ON fw.read_idx = reach.read_idx WHERE length > 0 AND (fw IS NULL OR (fw = reach.direction AND s = 0)))"],
        "SELECT read_idx, direction::BIGINT AS direction, s::BIGINT AS read_start, length::BIGINT AS length, rep::BIGINT AS rep FROM ch QUALIFY row_number() OVER (PARTITION BY read_idx ORDER BY s, length, direction) <= 1000", True),
    "best_mem": sql(mems(), f"SELECT {big('read_idx', 'direction', 'chr_idx', 'read_start', 'length', 'pos')} FROM mem QUALIFY row_number() OVER (PARTITION BY read_idx ORDER BY length DESC, direction, chr_idx, pos, read_start) = 1"),
    "seed_anchor_flag": sql([*mems(), SEEDS[0]], "SELECT read_idx, rep <= 1 AS is_anchor, count(*)::BIGINT AS n, sum(length)::BIGINT AS bases, max(rep)::BIGINT AS max_rep FROM seeds GROUP BY 1, 2"),
    "window_sessions": sql([*mems(), *SEEDS, *sessions()], f"SELECT {big('read_idx', 'direction', 'chr_idx', 'window_id', 'start_bin', 'end_bin', 'num_anchors')} FROM win"),
    "event_sessions": sql(["b AS (SELECT user_id, epoch_us(ts) // 60000000 AS bin, count(*) AS n FROM events GROUP BY 1, 2)", "g AS (SELECT *, bin - lag(bin) OVER (PARTITION BY user_id ORDER BY bin) AS gap FROM b)", "s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY bin) AS session FROM g)"], "SELECT user_id, session::BIGINT AS session, min(bin)::BIGINT AS start_bin, max(bin)::BIGINT AS end_bin, sum(n)::BIGINT AS n FROM s GROUP BY user_id, session"),
    "window_flank": sql([*mems(), *SEEDS, *sessions(), FLANK], f"SELECT {big('read_idx', 'direction', 'chr_idx', 'window_id', 'start_bin', 'end_bin', 'num_anchors')} FROM flanked"),
    "seed_to_window": sql(SEEDED, f"SELECT {big('read_idx', 'direction', 'chr_idx', 'window_id')}, count(*)::BIGINT AS seeds, count_if(is_anchor)::BIGINT AS anchors, sum(length)::BIGINT AS bases FROM asg GROUP BY ALL HAVING count_if(is_anchor) > 0"),
    "seed_subsume": sql(
        [*mems(SHORT_K), SEEDS[0], "seed AS (SELECT * REPLACE (length - read_start % 3 AS length), rep <= 50 AS is_anchor FROM seeds UNION ALL SELECT *, rep <= 50 FROM seeds)", *sessions(), *[p.replace("seed.*, window_id", "DISTINCT seed.*, window_id") for p in assigned("win")], *SUBSUME],
        f"SELECT {big('read_idx', 'direction', 'chr_idx', 'window_id', 'read_start', 'length', 'pos')} FROM sub"),
    "window_topk": sql(KEPT, f"SELECT {big('read_idx', 'direction', 'chr_idx', 'window_id', 'ordinal', 'read_start', 'length', 'pos', 'rep')} FROM kept"),
    "window_pairs": sql(PAIRS, f"SELECT {big('read_idx', 'direction', 'chr_idx', 'window_id', 'i', 'j', 'a_read', 'a_pos', 'a_length', 'b_read', 'b_pos', 'b_length')} FROM pairs"),
    "gap_classify": sql(
        [*PAIRS, "cut AS (SELECT *, greatest(a_read + a_length - b_read, 0) AS cut FROM pairs)", "gap AS (SELECT *, b_length - cut AS b2, b_read + cut - a_read - a_length AS read_gap, b_pos + cut - a_pos - a_length AS genome_gap FROM cut)"],
        f"SELECT {big('read_idx', 'direction', 'chr_idx', 'window_id', 'i', 'j', 'read_gap', 'genome_gap')}, b2::BIGINT AS b_length, CASE WHEN b2 <= 0 OR b_pos + b_length <= a_pos + a_length THEN 'CANNOT_STITCH' WHEN read_gap = 0 AND genome_gap = 0 THEN 'PERFECT_MATCH' WHEN genome_gap = read_gap THEN 'SAME_GAP' WHEN genome_gap - read_gap > 589824 THEN 'CANNOT_STITCH' WHEN genome_gap - read_gap >= 21 THEN 'SPLICE_JUNCTION' WHEN genome_gap > read_gap THEN 'DELETION' ELSE 'INSERTION' END AS type FROM gap"),
    "same_gap_score": sql(
        [G, "x AS (SELECT a.chr_idx, a.seq AS a, substr(b.seq, 2) AS b, least(length(a.seq), greatest(length(b.seq) - 1, 0)) AS n FROM g a JOIN g b ON b.chr_idx = a.chr_idx + 1)",
         "y AS (SELECT chr_idx, p, p <= n AS inside, substr(a, p, 1) = substr(b, p, 1) AS same FROM x, unnest(range(1, n + 2)) AS u(p))",
         "z AS (SELECT chr_idx, count_if(inside AND same) AS matched, count_if(inside AND NOT same) AS unmatched, min(p) FILTER (WHERE NOT (inside AND same)) - 1 AS prefix FROM y GROUP BY chr_idx)"],
        f"SELECT {big('chr_idx', 'matched', 'unmatched', 'prefix')}, (matched - unmatched)::BIGINT AS score FROM z"),
    "extend_prefix_max": sql(EXTEND, "SELECT bud.item_id::BIGINT AS item_id, bud.m::BIGINT AS m, coalesce(p, 0)::BIGINT AS length, coalesce(hit, 0)::BIGINT AS matches, coalesce(miss, 0)::BIGINT AS mismatches FROM bud LEFT JOIN top ON top.item_id = bud.item_id AND top.m = bud.m"),
    "score_upper_bound": sql([*KEPT, f"p AS (SELECT {W}, read_start, max(length + least(read_start, 10)) AS m FROM kept GROUP BY ALL)"], f"SELECT {big('read_idx', 'direction', 'chr_idx', 'window_id')}, sum(m)::BIGINT AS bound FROM p GROUP BY ALL"),
    "splice_motif": sql([*INTRONS[:2], f"m AS (SELECT chr_idx, j, {motif('substr(seq, s + 1, 2) || substr(seq, e, 2)', 0)} AS motif, {motif('substr(seq, s + 1, 2) || substr(seq, e, 2)', 1)} AS penalty FROM i)"], f"SELECT {big('chr_idx', 'j', 'motif', 'penalty')}, (CASE WHEN motif > 0 THEN 2 - motif % 2 ELSE 0 END)::BIGINT AS strand FROM m"),
    "junction_shift": sql(INTRONS, f"SELECT {big('chr_idx', 'j', 'shift_left', 'shift_right')} FROM sh"),
    "length_penalty": "SELECT l_orderkey, l_linenumber::BIGINT AS line, ceil(log2(l_quantity * 3 + 1.5) * -0.25 - 0.5)::BIGINT AS penalty FROM lineitem",
    "multimap_select": sql(SELECTED, f"SELECT {big('read_idx', 'chr_idx', 'genome_start', 'strand', 'score', 'matched')}, cigar, {big('hits')}, status FROM sel2"),
    "mapq_flag": sql(SELECTED, f"SELECT {big('read_idx', 'chr_idx', 'genome_start', 'strand')}, {MAPQ}::BIGINT AS mapq, (strand * 16)::BIGINT AS flag, (CASE strand WHEN 0 THEN 99 ELSE 83 END)::BIGINT AS flag_mate1, (CASE strand WHEN 0 THEN 147 ELSE 163 END)::BIGINT AS flag_mate2 FROM sel2"),
    "sam_record": sql(SELECTED, f"SELECT read_idx, concat_ws(chr(9), 'read' || read_idx, (strand * 16)::VARCHAR, 'doc' || chr_idx, (genome_start + 1)::VARCHAR, {MAPQ}::VARCHAR, cigar, '*', '0', '0', CASE strand WHEN 0 THEN r.seq ELSE {rc('r.seq')} END, '*') AS value FROM sel2 JOIN r USING (read_idx) WHERE status = 'SUCCESS'"),
    "align_report": sql(STATUS, "SELECT count(*)::BIGINT AS total, count_if(status = 'SUCCESS' AND hits = 1)::BIGINT AS \"unique\", count_if(status = 'SUCCESS' AND hits > 1)::BIGINT AS multi, count_if(status = 'TOO_MANY')::BIGINT AS too_many, count_if(status = 'SUCCESS' AND hits = 1) * 100.0::DOUBLE / count(*) AS unique_pct, count_if(status = 'SUCCESS' AND hits > 1) * 100.0::DOUBLE / count(*) AS multi_pct FROM status"),
    "read_status": sql(STATUS, "SELECT read_idx, status, hits FROM status"),
    "mate_zip": sql([f"t AS (SELECT conv_id, turn, {dna('text')} AS seq FROM conversations)", f"p AS (SELECT a.conv_id * 1000 + a.turn AS read_idx, a.seq AS m1, b.seq AS m2, a.seq || '#' || {rc('b.seq')} AS seq FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE length(a.seq) > 0 AND length(b.seq) > 0)"], "SELECT read_idx::BIGINT AS read_idx, length(m1)::BIGINT AS mate1_length, length(m2)::BIGINT AS mate2_length, length(seq)::BIGINT AS length, md5(seq) AS seq_md5 FROM p"),
    "exon_introns": sql(INTRON, f"SELECT {big('transcript', 'sj_start', 'sj_end', 'strand', 'gene')} FROM sj"),
    "transcript_bounds": sql(EXONS, "SELECT transcript, min(start)::BIGINT AS start, arg_max(\"end\", (start, \"end\"))::BIGINT AS \"end\" FROM ex GROUP BY transcript"),
    "junction_collapse": sql([*INTRON, "d AS (SELECT DISTINCT sj_start, sj_end, strand, gene FROM sj)"], f"SELECT {big('sj_start', 'sj_end', 'strand')}, 20::BIGINT AS priority, string_agg(gene::VARCHAR, ',' ORDER BY gene) AS genes FROM d GROUP BY sj_start, sj_end, strand"),
    "exon_chr_semi": sql([*LAYOUT, *EXONS], "SELECT transcript, line::BIGINT AS line, chr, (ex.start + c.start - 1)::BIGINT AS start, (ex.\"end\" + c.start - 1)::BIGINT AS \"end\" FROM ex JOIN chrs c ON c.name = ex.chr WHERE ex.\"end\" <= c.length"),
    "exon_chr_anti": sql([*LAYOUT, *EXONS], "SELECT chr, CASE WHEN c.name IS NULL THEN 'unknown chromosome' ELSE 'past the chromosome''s end' END AS reason, count(*)::BIGINT AS n FROM ex LEFT JOIN chrs c ON c.name = ex.chr WHERE c.name IS NULL OR ex.\"end\" > c.length GROUP BY 1, 2"),
    "junction_dedup1": sql(DEDUP1, f"SELECT {big('start')}, \"end\"::BIGINT AS \"end\", {big('strand', 'motif', 'priority', 'shift_left', 'shift_right', 'ordinal')} FROM dd"),
    "junction_dedup2": sql(DEDUP1, f"SELECT {big('start')}, \"end\"::BIGINT AS \"end\", {big('strand', 'motif', 'priority', 'shift_left', 'shift_right', 'ordinal')} FROM dd QUALIFY row_number() OVER (PARTITION BY start, \"end\" ORDER BY strand > 0 DESC, priority DESC, motif > 0 DESC, (motif > 0 AND strand = 2 - motif % 2) DESC, ordinal) = 1"),
    "junction_flanks": sql(INTRONS[:2], "SELECT (chr_idx * 5 + j)::BIGINT AS sj_idx, substr(seq, greatest(s - 30, 0) + 1, least(s, 30)) || substr(seq, e + 2, 30) || '#####' AS sj_seq FROM i"),
    "junction_split": sql(
        [*INTRONS[:2], "h AS (SELECT l_orderkey * 10 + l_linenumber AS hit, (l_orderkey * 37 + l_linenumber * 11) % 200000 AS place, l_quantity::BIGINT AS len, l_suppkey % 30 AS rs FROM lineitem)",
         "x AS (SELECT hit, place // 65 AS sj_idx, place % 65 AS off, len, rs FROM h WHERE place % 65 < 30 AND place % 65 + len > 30 AND place % 65 + len <= 60)", "y AS (SELECT hit, x.sj_idx, off, len, rs, s, e FROM x JOIN i ON i.chr_idx * 5 + i.j = x.sj_idx)"],
        "SELECT hit::BIGINT AS hit, sj_idx::BIGINT AS sj_idx, 0::BIGINT AS part, (s - (30 - off))::BIGINT AS pos, (30 - off)::BIGINT AS length, rs::BIGINT AS read_start FROM y UNION ALL SELECT hit, sj_idx, 1, e + 1, len - (30 - off), rs + 30 - off FROM y"),
    "junction_database": sql(DATABASE, f"SELECT {big('chr_idx', 'start')}, \"end\"::BIGINT AS \"end\", {big('strand', 'motif', 'shift_left', 'shift_right', 'donor')}, sj_seq FROM db"),
    "annotated_parts": sql(PARTS, f"SELECT {big('read_idx', 'direction', 'read_start', 'length', 'repeat')}, count(*)::BIGINT AS places, sum(pos)::BIGINT AS pos_sum, min(chr_idx)::BIGINT AS first_chr FROM jp GROUP BY 1, 2, 3, 4, 5"),
    "dictionary_encode": sql(["f AS (SELECT o_orderpriority, min(o_orderkey) AS first_key, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_custkey, o_orderkey) AS o_custkey FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)"], "SELECT o_orderpriority, o_orderstatus, o_custkey, (row_number() OVER (ORDER BY first_key, o_orderpriority) - 1)::BIGINT AS code FROM f"),
}
