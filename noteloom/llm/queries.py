"""The registered queries of this subpackage: thin wrappers over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sharding
from .chat_format import format_chats
from .common import table
from .decontaminate import find_contamination
from .hamming_search import search_embeddings
from .html_extract import extract_pages
from .near_dedup import near_duplicates
from .packing import pack_documents
from .phrases import mine_phrases
from .pii import find_pii
from .quality import judge
from .sentencepiece_bpe import encode_documents
from .url_filter import filter_urls, host_path_rule, pattern_rule
from .whitening import whiten

#: Fixed host/path rules of the contract.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words of unwanted hosts and paths; the patterns made of them are tried where no host/path rule fits.
BLOCK_WORDS = ("ads", "adserver", "bets", "betting", "casino", "escort", "jackpot", "payday", "pills", "poker", "porn", "slots", "viagra", "xxx")
#: Numbers that numbered hosts and paths of these words run through.
BLOCK_NUMBERS = 60


def block_patterns() -> list[str]:
    """About 2,500 patterns with host anchors, wildcards and separators: each word alone, its numbered hosts, and its paths and files that end in a number."""
    numbered = [p for w in BLOCK_WORDS for n in range(BLOCK_NUMBERS) for p in (f"||{w}{n}.", f"/{w}/*-{n}^", f"^{w}-*{n}.html")]
    return [*(f"^{w}^" for w in BLOCK_WORDS), "||tracker-*.", "/popunder^", "||spam-*.", *numbered]


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_embeddings(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=24).drop("row_number")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_path_rule(v, s) for v, s in HOST_RULES] + [pattern_rule("block", p) for p in block_patterns()]
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("copy_id")


def op11_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), k=8)


def op12_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"), support=100, top=2000)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_feistel_sharding": op2_feistel_sharding,
    "op3_url_filter": op3_url_filter,
    "op4_chat_format": op4_chat_format,
    "op5_html_extract": op5_html_extract,
    "op6_kneser_ney_quality": op6_kneser_ney_quality,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_order_minhash": op10_order_minhash,
    "op11_svd_whitening": op11_svd_whitening,
    "op12_nnls_packing": op12_nnls_packing,
    "op13_phrase_growth": op13_phrase_growth,
}


def _op2_sql() -> str:
    """The same law in SQL: row numbers by doc_id, the Feistel rounds as a recursive walk, CRC-32 bit by bit over table steps."""
    steps, prev = [], ("l0", "r0")
    for i, k in enumerate(sharding.ROUND_KEYS):
        side = "b" if i % 2 else "a"
        steps.append(f"select id, n, a, b, hop, {prev[1]} as l{i + 1}, ({prev[0]} + {_mix_sql(prev[1], k)}) % {side} as r{i + 1} from s{i}")
        prev = (f"l{i + 1}", f"r{i + 1}")
    chain = "(select id, n, a, b, hop, x // b as l0, x % b as r0 from walk where hop = 0 or x >= n)"
    for i, text in enumerate(steps):
        chain = f"({text.replace(f'from s{i}', f'from {chain}')})"
    last = len(sharding.ROUND_KEYS)
    return f"""
with recursive numbered as (
  select doc_id, text, row_number() over (order by doc_id nulls first) - 1 as id, count(*) over () as n from documents),
sized as (select *, ceil(sqrt(n))::bigint as a, ceil(n / ceil(sqrt(n)))::bigint as b from numbered),
walk(id, n, a, b, hop, x) as (
  select id, n, a, b, 0, id from sized
  union all
  select id, n, a, b, hop + 1, l{last} * b + r{last} from {chain}),
placed as (select id, x from walk where hop > 0 and x < n),
crc_table as (
  select list(list_reduce(list_prepend(i::bigint, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
bytes as (select doc_id, text, id, case when text is null then null else list_prepend(4294967295::bigint, list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(hex(encode(text)), (2 * i - 1)::bigint, 2))::bigint)) end as bs from sized)
select doc_id, coalesce(strlen(text), 0) + 8 as size,
  case when text is not null then xor(list_reduce(bs, lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) end as text_crc32,
  'rows' as law, (x % 24)::int as shard, x // 24 as slot, null::int as grown_shard
from bytes join placed using (id), crc_table"""


def _mix_sql(v: str, key: int) -> str:
    t = f"(({v} * {sharding.MULT_A} + {key}) & {sharding.MASK})"
    t = f"xor({t}, {t} >> 15)"
    t = f"(({t} * {sharding.MULT_B}) & {sharding.MASK})"
    return f"xor({t}, {t} >> 13)"


_HOST = r"coalesce(translate(regexp_extract(u.rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_RULES = ", ".join(f"('{v}', '{s}', '{s.split('/', 1)[0]}', '/{s.split('/', 1)[1]}')" for v, s in HOST_RULES)
_EDGE = "([^A-Za-z0-9]|$)"
OP3_SQL = rf"""
with u as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest, url from pages),
parts as (select page_id, {_HOST} as host, coalesce(regexp_extract(u.rest, '^[^/?#]*([^?#]*)', 1), '') as path, url from u),
rules(rule_verdict, rule, rule_host, rule_path) as (values {_RULES}),
best as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(rule_verdict, length(rule)) as rule_verdict
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id),
words as (select unnest(['{"', '".join(BLOCK_WORDS)}']) as word), numbers as (select unnest(range({BLOCK_NUMBERS})) as n),
patterns as (
  select '^' || word || '^' as pattern, word as literal, '(^|[^A-Za-z0-9])' || word || '{_EDGE}' as regex from words
  union all select '||tracker-*.', 'tracker-', '^([^/]*\.)?tracker-.*\.'
  union all select '/popunder^', '/popunder', '/popunder{_EDGE}'
  union all select '||spam-*.', 'spam-', '^([^/]*\.)?spam-.*\.'
  union all select '||' || word || n || '.', word || n || '.', '^([^/]*\.)?' || word || n || '\.' from words, numbers
  union all select '/' || word || '/*-' || n || '^', '/' || word || '/', '/' || word || '/.*-' || n || '{_EDGE}' from words, numbers
  union all select '^' || word || '-*' || n || '.html', word || '-', '(^|[^A-Za-z0-9])' || word || '-.*' || n || '\.html' from words, numbers),
hits as (
  select page_id, min(pattern) as pattern from (select page_id, host || path as place from parts where url is not null) join patterns on contains(place, literal)
  where regexp_matches(place, '(?s)' || regex) group by page_id)
select page_id, host, path, rule, coalesce(rule_verdict, case when pattern is null then 'allow' else 'block' end) as verdict,
  case when rule is null then pattern end as pattern
from parts left join best using (page_id) left join hits using (page_id)"""

OP4_SQL = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, count(*) over (partition by conv_id) as n_turns from turns),
prefixes as (
  select conv_id, k, n_turns, string_agg(strlen(role) || ':' || role || ':' || strlen(text) || ':' || text, '') over (partition by conv_id order by k) as chain,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') over (partition by conv_id order by k) as rendered
  from numbered),
ends as (select conv_id, chain, rendered, n_turns from prefixes where k = n_turns),
whole as (select chain, rendered, n_turns, min(conv_id) as conv_id, count(*) as n_copies from ends group by all),
maximal as (select * from whole where chain not in (select chain from prefixes where k < n_turns)),
absorbed as (
  select e.conv_id, min(m.conv_id) as kept_id from ends e join prefixes p on p.chain = e.chain and p.k < p.n_turns join maximal m on m.conv_id = p.conv_id group by e.conv_id)
select conv_id, n_turns::int as n_turns, n_copies, (select count(*) from absorbed where kept_id = maximal.conv_id) as n_snapshots, rendered from maximal"""

OP1_SQL = """
with pairs as (
  select q.vec_id as query_id, r.vec_id as id,
    list_sum(list_transform(range(1, 65), lambda i: (coalesce(q.embedding[i] > 0, false) <> coalesce(r.embedding[i] > 0, false))::int))::int as distance
  from embeddings q, embeddings r where q.vec_id % 100 = 0)
select query_id, row_number() over (partition by query_id order by distance, id)::int as rank, id, distance from pairs
qualify rank <= 10"""

_WORDS_OF = "select {id}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as words from {t}"
OP8_SQL = f"""
with item_words as ({_WORDS_OF.format(id="item_id", t="benchmark")}), doc_words as ({_WORDS_OF.format(id="doc_id", t="documents")}),
sizes as (select distinct least(len(words), 5) as k from item_words where len(words) > 0),
items as (
  select distinct item_id, array_to_string(words[i:i + least(len(words), 5) - 1], ' ') as shingle from item_words, unnest(range(1, len(words) - least(len(words), 5) + 2)) r(i) where len(words) > 0),
held as (select distinct doc_id, array_to_string(words[i:i + k - 1], ' ') as shingle from doc_words, sizes, unnest(range(1, len(words) - k + 2)) r(i)),
counts as (select item_id, count(*) as n from items group by item_id)
select doc_id, item_id, count(*) / any_value(n) as containment
from held join items using (shingle) join counts using (item_id)
group by doc_id, item_id having count(*) >= 0.8 * any_value(n) - 1e-9"""

OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda w: w <> '') as ws from pieces),
totals as (select lang, sum(len(ws))::bigint as n from words group by lang),
counts as (
  select lang, ws[i:i + m - 1] as phrase, count(*) as f from words, range(1, 6) s(m), unnest(range(1, len(ws) - m + 2)) r(i)
  where len(ws) >= m group by all having count(*) >= 100),
cands as (select lang, phrase, f as a from counts where len(phrase) > 1),
longer as (
  select lang, phrase[i:i + m - 1] as phrase, max(a) as b from cands, range(2, 5) s(m), unnest(range(1, len(phrase) - m + 2)) r(i)
  where len(phrase) > m group by all),
kept as (select c.lang, c.phrase, a from cands c left join longer g on c.lang = g.lang and c.phrase = g.phrase where b is null or 100 * b < 100 * a),
cuts as (
  select k.lang, k.phrase, k.a, c as cut, x.f as l, y.f as r, n, (1000::hugeint * k.a * n) // (x.f::hugeint * y.f) as score
  from kept k, range(1, 5) s(c), counts x, counts y, totals t
  where c < len(k.phrase) and x.lang = k.lang and x.phrase = k.phrase[1:c] and y.lang = k.lang and y.phrase = k.phrase[c + 1:] and t.lang = k.lang),
least as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
named as (select lang, array_to_string(phrase, ' ') as phrase, a, l, r, n, score::bigint as score from least)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from named
qualify rank <= 2000"""

ORACLES: dict[str, str] = {
    "op1_hamming_topk": OP1_SQL,
    "op2_feistel_sharding": _op2_sql(),
    "op3_url_filter": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op8_decontamination": OP8_SQL,
    "op13_phrase_growth": OP13_SQL,
}
