"""SQL for the queries whose results SQL can express."""

from scorewright.llm import lexical

ORACLES = {
    "op12_lexical": lexical.ORACLE,
    "op9_pivots": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
            from embeddings
            where embedding is not null and vec_id is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), pairs as (
            select q.vec_id as query_id, c.vec_id,
                   list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
            where q.vec_id % 50 = 0
        ), ranked as (
            select query_id, vec_id, score,
                   (row_number() over (partition by query_id order by score desc, vec_id))::int
                       as rank
            from pairs
        )
        select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
}
