"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm.caps import embedding_components
from tablecare.llm.chat import chat_digests, written_chat
from tablecare.llm.ids import id_digests, write_ids
from tablecare.llm.mixing import mix, token_count
from tablecare.llm.packing import document_pieces, pack_pieces
from tablecare.llm.paragraphs import without_passages
from tablecare.llm.periods import Words, periodic_runs
from tablecare.llm.phrases import collocations
from tablecare.llm.rules import held_out, learn_quality, score_quality
from tablecare.llm.search import nearest_neighbours
from tablecare.llm.simhash import simhash_components
from tablecare.llm.transforms import repeated_string_digests
from tablecare.llm.wrappers import main_text
from tablecare.session import configure, scratch_path


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    return simhash_components(_table(spark, sf_dir, "documents"))


def op2_token_ids(spark, sf_dir):
    path = scratch_path(spark, "token-ids")
    documents = _table(spark, sf_dir, "documents")
    write_ids(documents, path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return id_digests(spark, path)


def op3_mixing(spark, sf_dir):
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        "source",
        token_count(F.col("text")).alias("tokens"),
        F.round("weight", 6).alias("weight"),
        F.round("exponent", 6).alias("exponent"),
        "copy",
        "block",
        "order_key",
    )


def op4_embedding_caps(spark, sf_dir):
    return embedding_components(_table(spark, sf_dir, "embeddings"))


def op5_paragraphs(spark, sf_dir):
    cleaned = without_passages(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "removed_paragraphs", "removed_components")


def op6_quality(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    model = learn_quality(documents, _table(spark, sf_dir, "labels"))
    return score_quality(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op7_main_text(spark, sf_dir):
    return main_text(_table(spark, sf_dir, "pages"))


def op8_packing(spark, sf_dir):
    documents, tokenizer = _table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")
    return pack_pieces(document_pieces(documents, tokenizer, with_ids=False)).drop("row")


def op9_neighbours(spark, sf_dir):
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_chat(spark, sf_dir):
    conversations = _table(spark, sf_dir, "conversations")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)],
        "conv_id long, turn long, role string, text string",
    )
    rows = conversations.select("conv_id", "turn", "role", "text").union(extra)
    return chat_digests(written_chat(rows))


def with_repeats(doc_id: int | None, words: Words) -> Words:
    """For every tenth id by its hash, the words with a periodic end."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periods(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    return periodic_runs(documents, change=with_repeats, texts=False)


def op12_repeats(spark, sf_dir):
    return repeated_string_digests(_table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        q.__name__: q
        for q in (
            op1_simhash, op2_token_ids, op3_mixing, op4_embedding_caps, op5_paragraphs,
            op6_quality, op7_main_text, op8_packing, op9_neighbours, op10_chat,
            op11_periods, op12_repeats, op13_collocations,
        )
    }


def oracle_sql() -> dict[str, str]:
    """In DuckDB, over whole tables. The others learn, use a tokenizer or a hash that
    DuckDB lacks, or are approximate; their tests compare with brute force."""
    return {
        "op3_mixing": MIXING_SQL,
        "op4_embedding_caps": CAPS_SQL,
        "op10_chat": CHAT_SQL,
        "op13_collocations": PHRASES_SQL,
    }


MIXING_SQL = r"""
with recursive counted as (
    select doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as tokens
    from documents
), totals as (
    select source, sum(tokens)::bigint as total, count(*) as docs from counted group by source
), shares as (
    select *, total / (select sum(total) from totals)::double as share from totals
), listed as (
    select list(share order by source) as shares from shares where total > 0
), steps as (
    select 0 as step, 0.0::double as low, 1.0::double as high, shares from listed
    union all
    select step + 1,
        case when repeats > 2 then middle else low end,
        case when repeats > 2 then high else middle end, shares
    from (
        select *, list_max(list_transform(shares, lambda s: pow(s, middle) / s))
            / list_min(list_transform(shares, lambda s: pow(s, middle) / s)) as repeats
        from (select *, (low + high) / 2 as middle from steps where step < 20)
    )
), ends as (
    select case
        when len(shares) = 0 then 1.0
        when list_max(shares) / list_min(shares) <= 2 then 0.0
        else high end as exponent
    from steps where step = 20
), powers as (
    select *, pow(share, exponent) as power from shares, ends
), plan as (
    select *, power / (select sum(power) from powers) as weight,
        (select max(total / power) from powers) * power as quota,
        ceil(docs / 10000.0)::bigint as blocks
    from powers
), passes as (
    select *, floor(quota / total + 1e-9)::bigint as passes from plan
), keyed as (
    select c.*, p.weight, p.exponent, p.passes, p.blocks,
        greatest(0.0, p.quota - p.passes * p.total) as rest, copies.copy,
        md5(concat_ws('|', '1', copies.copy, c.source, c.doc_id)) as order_key
    from counted c join passes p using (source), generate_series(0, p.passes) copies(copy)
), dealt as (
    select *, ('0x' || substr(order_key, 1, 12))::bigint % blocks as block from keyed
), ran as (
    select *, sum(tokens) over (
        partition by source, copy order by block, order_key range unbounded preceding
    ) as taken from dealt
)
select doc_id, source, tokens, round(weight, 6) as weight, round(exponent, 6) as exponent,
    copy, block, order_key
from ran where copy < passes or taken <= rest
"""

CAPS_SQL = """
with recursive usable as (
    select vec_id, embedding::double[] as v from embeddings
    where embedding is not null and list_sum(list_transform(embedding, lambda x: abs(x))) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), links as (
    select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id
    where list_cosine_similarity(a.v, b.v) >= 0.95
), reached as (
    select a as node, a as root from links
    union
    select links.a, reached.root from links join reached on links.b = reached.node
), component as (
    select node, min(root) as root from reached group by node
), counted as (
    select a, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0) as n_links, coalesce(root, vec_id) as component_id,
    coalesce(root, vec_id) = vec_id as kept
from embeddings left join counted on a = vec_id left join component on node = vec_id
"""

CHAT_SQL = r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), counted as (
    select *, length(text) + len(regexp_extract_all(text, '\\|<\||\|>|\[INST\]|\[/INST\]|<s>|</s>'))
        as escaped,
        lag(role, 1, '') over (partition by conv_id order by turn, role, text) as before,
        lead(role, 1, '') over (partition by conv_id order by turn, role, text) as after
    from rows
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text))
        as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), ''))
        as loss_sha256,
    sum(escaped + case role when 'system' then 19 when 'user' then 16 else 15 end)::bigint
        as formatted_chars,
    bool_and((before, role) in (
        ('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'),
        ('assistant', 'user')
    ) and (after <> '' or role = 'assistant')) as valid
from counted group by conv_id
"""

PHRASES_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) as piece
    from documents where text is not null
), sequences as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces
), counts as (
    select lang, size, array_to_string(words[i:i + size - 1], ' ') as phrase, count(*) as f
    from (
        select lang, words, size, unnest(generate_series(1, len(words) - size + 1)) as i
        from sequences, generate_series(1, 3) sizes(size)
    ) group by all
), totals as (
    select lang, sum(f)::bigint as n from counts where size = 1 group by lang
), phrases as (
    select *, string_split(phrase, ' ') as words from counts where size > 1 and f >= 10
), cuts as (
    select p.lang, p.phrase, p.words, p.f as a, k, l.f as l, r.f as r,
        (1000000::hugeint * p.f * p.f) // (l.f::hugeint * r.f) as score
    from (select *, unnest(generate_series(1, size - 1)) as k from phrases) p
    join counts l on l.lang = p.lang and l.phrase = array_to_string(p.words[1:k], ' ')
    join counts r on r.lang = p.lang and r.phrase = array_to_string(p.words[k + 1:p.size], ' ')
), best as (
    select * from cuts
    qualify row_number() over (partition by lang, phrase order by score, k) = 1
), longer as (
    select lang, inner_phrase, max(f) as f from (
        select lang, f, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')])
            as inner_phrase
        from phrases where size = 3
    ) group by all
), ranked as (
    select b.*, row_number() over (
        partition by b.lang order by score desc, a desc, b.phrase
    ) as rank
    from best b left join longer on longer.lang = b.lang and inner_phrase = b.phrase
    where longer.f is null or 100 * longer.f < 50 * a
)
select lang, rank, phrase, a, l, r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""
