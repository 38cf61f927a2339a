"""The queries in DuckDB SQL, from shared building blocks."""

from __future__ import annotations

import re

BLOCKS: dict[str, str] = {
    "keyed": "SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "uses": """SELECT DISTINCT 'G' || user_id AS source,
        (CASE WHEN event_type IN ('purchase','signup') THEN 'S' ELSE 'T' END) || event_type || (k // 10) || '.' || (k % 10) AS target,
        strftime(ts, '%Y-%m-%d') AS reference FROM keyed""",
    "actors": "SELECT source AS actor_id, row_number() OVER (ORDER BY source) - 1 AS ord FROM (SELECT DISTINCT source FROM uses)",
    "usage": "SELECT target AS item_id, count(DISTINCT source) AS usage FROM uses GROUP BY 1",
    "ng": "SELECT count(DISTINCT source) AS n_groups FROM uses",
    "kb": """SELECT item_id, CASE WHEN item_id LIKE 'S%' THEN 'tool' ELSE 'ttp' END AS kind, split_part(item_id, '.', 1) AS parent, usage, n_groups,
        usage >= n_groups * 0.15 AS is_common, usage BETWEEN 1 AND 13 AS is_rare, ln((1.0 + n_groups) / (1.0 + usage)) + 1 AS idf FROM usage, ng""",
    "profile": "SELECT DISTINCT source AS actor_id, target AS item_id, split_part(target, '.', 1) AS parent FROM uses",
    "support": "SELECT source, target, count(DISTINCT reference) AS n_refs, min(reference) AS ref1 FROM uses GROUP BY 1, 2",
    "inc0": """SELECT u.source, u.reference, u.n_items, coalesce(r.n_removed, 0) AS n_removed, s.n_all - coalesce(r.n_removed, 0) AS n_left
        FROM (SELECT source, reference, count(DISTINCT target) AS n_items FROM uses GROUP BY 1, 2 HAVING count(DISTINCT target) >= 4) u
        JOIN (SELECT source, count(DISTINCT target) AS n_all FROM uses GROUP BY 1) s ON s.source = u.source
        LEFT JOIN (SELECT source, ref1 AS reference, count(*) AS n_removed FROM support WHERE n_refs = 1 GROUP BY 1, 2) r
          ON r.source = u.source AND r.reference = u.reference
        WHERE s.n_all - coalesce(r.n_removed, 0) >= 8""",
    "incidents": """SELECT source || '|' || reference AS incident_id, source AS grp, reference, n_items, n_removed, n_left,
        row_number() OVER (PARTITION BY source ORDER BY reference) AS rn FROM inc0""",
    "inc3": "SELECT * FROM incidents WHERE rn <= 3",
    "frames": "SELECT a.actor_id AS grp, b.actor_id AS framed FROM actors a JOIN actors b ON b.ord = (a.ord + 1) % (SELECT count(*) FROM actors)",
    # Static cases: incidents of every group against full profiles.
    "items": "SELECT DISTINCT i.incident_id AS case_id, u.target AS item_id FROM inc3 i JOIN uses u ON u.source = i.grp AND u.reference = i.reference",
    "marks": "SELECT i.incident_id AS case_id, f.framed AS target, g AS i FROM inc3 i JOIN frames f ON f.grp = i.grp, generate_series(1, 3) t(g)",
    "norms": "SELECT actor_id, sum(idf * idf) AS norm2 FROM profile JOIN kb USING (item_id) GROUP BY 1",
    "seen": "SELECT case_id, item_id, idf FROM items JOIN kb USING (item_id)",
    "cosines": """SELECT h.case_id, h.actor_id, h.dot / (sqrt(o.obs2) * sqrt(n.norm2)) AS cosine, h.matched / o.obs AS coverage FROM
        (SELECT case_id, actor_id, sum(idf * idf) AS dot, sum(idf) AS matched FROM seen JOIN profile USING (item_id) GROUP BY 1, 2) h
        JOIN (SELECT case_id, sum(idf * idf) AS obs2, sum(idf) AS obs FROM seen GROUP BY 1) o USING (case_id) JOIN norms n USING (actor_id)""",
    "sims": """SELECT case_id, actor_id, coalesce(cosine, 0) AS cosine, coalesce(coverage, 0) AS coverage, coalesce(cosine, 0) + 0.15 * coalesce(m, 0) AS score
        FROM cosines FULL JOIN (SELECT case_id, target AS actor_id, count(*) AS m FROM marks GROUP BY 1, 2) USING (case_id, actor_id)""",
    "ranks": """SELECT s.*, a.ord, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, a.ord) AS rank
        FROM sims s JOIN actors a USING (actor_id)""",
    "cand": """SELECT case_id, actor_id, ord FROM ranks WHERE rank <= 8 UNION
        SELECT m.case_id, m.target, a.ord FROM marks m JOIN actors a ON a.actor_id = m.target""",
    "ev": """SELECT case_id, 'E' || row_number() OVER (PARTITION BY case_id ORDER BY item_id) AS evidence_id, kind, item_id AS value, CAST(NULL AS VARCHAR) AS target,
        FALSE AS spoofable, 0.85 * 0.85 AS base_weight, is_common, is_rare, parent FROM items JOIN kb USING (item_id)
        UNION ALL SELECT case_id, 'M' || i, (['code_overlap','metadata','language_artifact','claim'])[((i - 1) % 4 + 1)::INT], '', target, TRUE, 0.85 * 0.85, FALSE, FALSE, '' FROM marks""",
    "near": "SELECT DISTINCT actor_id, parent FROM profile WHERE item_id LIKE 'T%'",
    "acells": """SELECT e.case_id, e.evidence_id, c.actor_id, e.spoofable, CASE
        WHEN e.target IS NOT NULL THEN CASE WHEN e.target = c.actor_id THEN (CASE WHEN e.spoofable THEN 1 ELSE 2 END) ELSE (CASE WHEN e.spoofable THEN -1 ELSE -2 END) END
        WHEN e.kind = 'ttp' AND e.is_common THEN 0
        WHEN e.kind = 'ttp' AND p.item_id IS NOT NULL THEN (CASE WHEN e.is_rare THEN 2 ELSE 1 END)
        WHEN e.kind = 'ttp' AND n.parent IS NOT NULL THEN 0
        WHEN e.kind = 'ttp' THEN -1
        WHEN e.kind = 'tool' AND p.item_id IS NOT NULL THEN (CASE WHEN e.is_common THEN 1 ELSE 2 END)
        WHEN e.kind = 'tool' THEN (CASE WHEN e.is_common THEN 0 ELSE -1 END) ELSE 0 END AS rating
        FROM ev e JOIN cand c USING (case_id) LEFT JOIN profile p ON p.actor_id = c.actor_id AND p.item_id = e.value
        LEFT JOIN near n ON n.actor_id = c.actor_id AND n.parent = e.parent""",
    "hyps": """SELECT case_id, actor_id AS hyp_id, 'actor' AS kind, actor_id, ord FROM cand
        UNION ALL SELECT case_id, 'FF-' || target, 'false_flag', target, 1000000 + row_number() OVER (PARTITION BY case_id ORDER BY target)
          FROM (SELECT DISTINCT case_id, target FROM marks)
        UNION ALL SELECT DISTINCT case_id, 'UNKNOWN', 'unknown', CAST(NULL AS VARCHAR), 2000000 FROM ev""",
    "mat": """SELECT case_id, evidence_id, actor_id AS hyp_id, rating FROM acells
        UNION ALL SELECT e.case_id, e.evidence_id, h.hyp_id, CASE WHEN e.spoofable THEN (CASE WHEN e.target = h.actor_id THEN 2 ELSE 0 END)
          WHEN a.rating <= -1 THEN 1 WHEN a.rating >= 1 THEN -1 ELSE 0 END
          FROM ev e JOIN hyps h ON h.case_id = e.case_id AND h.kind = 'false_flag'
          LEFT JOIN acells a ON a.case_id = e.case_id AND a.evidence_id = e.evidence_id AND a.actor_id = h.actor_id
        UNION ALL SELECT e.case_id, e.evidence_id, h.hyp_id, CASE WHEN NOT e.spoofable AND b.best = 2 THEN -1 ELSE 0 END
          FROM ev e JOIN hyps h ON h.case_id = e.case_id AND h.kind = 'unknown'
          LEFT JOIN (SELECT case_id, evidence_id, max(rating) AS best FROM acells GROUP BY 1, 2) b ON b.case_id = e.case_id AND b.evidence_id = e.evidence_id""",
    "wts": """SELECT e.case_id, e.evidence_id, e.spoofable, s.spread, e.base_weight * s.spread * (CASE WHEN e.spoofable THEN 0.5 ELSE 1.0 END) AS weight
        FROM ev e JOIN (SELECT case_id, evidence_id, (max(rating) - min(rating)) / 4.0 AS spread FROM mat GROUP BY 1, 2) s USING (case_id, evidence_id)""",
    "sums": """SELECT case_id, hyp_id, sum(CASE WHEN rating < 0 THEN rating * weight ELSE 0 END) AS inconsistency, sum(CASE WHEN rating > 0 THEN rating * weight ELSE 0 END) AS support,
        sum(CASE WHEN rating > 0 AND spoofable THEN rating * weight ELSE 0 END) AS spoof FROM mat JOIN wts USING (case_id, evidence_id) GROUP BY 1, 2""",
    "scored": """SELECT case_id, hyp_id, kind, actor_id, inconsistency, support, CASE WHEN round(support, 9) > 0 THEN spoof / support ELSE 0 END AS spoof_ratio, ord,
        row_number() OVER (PARTITION BY case_id ORDER BY round(inconsistency, 9) DESC, CASE kind WHEN 'unknown' THEN 0 WHEN 'false_flag' THEN 1 ELSE 2 END, round(support, 9) DESC, ord) AS rank
        FROM sums JOIN hyps USING (case_id, hyp_id)""",
    "signs": """SELECT m.case_id, count(DISTINCT m.target) > 1 AS many, count(DISTINCT CASE WHEN a.rating < 0 AND NOT a.spoofable THEN a.actor_id END) AS contradicted
        FROM (SELECT DISTINCT case_id, target FROM marks) m LEFT JOIN acells a ON a.case_id = m.case_id AND a.actor_id = m.target GROUP BY 1""",
    "assessed": """SELECT l.case_id, l.hyp_id AS "leading", l.kind AS leading_kind, l.actor_id AS leading_actor, t.total, t.n_diag,
        round((l.inconsistency - coalesce(s.inconsistency, l.inconsistency)) / t.total, 9) AS gap, l.spoof_ratio AS ratio1,
        coalesce(g.many, FALSE) OR coalesce(g.contradicted, 0) > 0 AS flagged,
        coalesce(l.kind = 'actor' AND round((l.inconsistency - f.inconsistency) / t.total, 9) < 0.35, FALSE) AS close_ff
        FROM (SELECT * FROM scored WHERE rank = 1) l
        JOIN (SELECT case_id, CASE WHEN sum(weight) > 0 THEN sum(weight) ELSE 1e-9 END AS total, count(*) FILTER (round(weight, 9) > 0) AS n_diag FROM wts GROUP BY 1) t USING (case_id)
        LEFT JOIN (SELECT * FROM scored WHERE rank = 2) s ON s.case_id = l.case_id LEFT JOIN signs g ON g.case_id = l.case_id
        LEFT JOIN (SELECT * FROM scored WHERE kind = 'false_flag') f ON f.case_id = l.case_id AND f.actor_id = l.actor_id""",
    "graded": """SELECT *, (['low','moderate','high'])[(least(CASE WHEN gap >= 0.35 AND n_diag >= 5 THEN 2 WHEN gap >= 0.15 AND n_diag >= 3 THEN 1 ELSE 0 END,
        CASE WHEN round(ratio1, 9) >= 0.5 THEN 0 ELSE 2 END, CASE WHEN leading_kind <> 'actor' THEN 1 ELSE 2 END, CASE WHEN close_ff THEN 1 ELSE 2 END,
        CASE WHEN flagged THEN 1 ELSE 2 END) + 1)::INT] AS confidence FROM assessed""",
    # Hold-out worlds: an incident's group without what only its report tells, or (open) without the group.
    "wcs": """SELECT i.incident_id || '#' || s AS case_id, i.incident_id, i.grp, i.reference, s AS setting, f.framed,
        CASE s WHEN 'false_flag' THEN f.framed WHEN 'authentic' THEN i.grp END AS target, i.incident_id || (CASE WHEN s = 'open' THEN '#o' ELSE '#c' END) AS world
        FROM inc3 i JOIN frames f ON f.grp = i.grp, (SELECT unnest(['closed', 'open', 'false_flag', 'authentic', 'mimicry']) AS s) t""",
    "wld": "SELECT DISTINCT world, incident_id, grp, reference, setting = 'open' AS is_open FROM wcs",
    "wdelta": "SELECT w.world, w.grp, p.target AS item_id FROM wld w JOIN support p ON p.source = w.grp AND (w.is_open OR (p.n_refs = 1 AND p.ref1 = w.reference))",
    "mim": """SELECT incident_id, framed, item_id, rn FROM (SELECT i.incident_id, f.framed, u.item_id, row_number() OVER (PARTITION BY i.incident_id ORDER BY k.usage, u.item_id) AS rn
        FROM inc3 i JOIN frames f ON f.grp = i.grp JOIN profile u ON u.actor_id = f.framed JOIN usage k ON k.item_id = u.item_id
        WHERE NOT EXISTS (SELECT 1 FROM uses v WHERE v.source = i.grp AND v.reference = i.reference AND v.target = u.item_id)) WHERE rn <= 3""",
    "wobs": """SELECT c.case_id, c.world, u.target AS item_id FROM wcs c JOIN uses u ON u.source = c.grp AND u.reference = c.reference
        UNION SELECT c.case_id, c.world, m.item_id FROM wcs c JOIN mim m ON m.incident_id = c.incident_id WHERE c.setting = 'mimicry'""",
    "wk": """SELECT w.world, k.item_id, ln((1.0 + k.n_groups - w.is_open::INT) / (1.0 + k.usage - (d.item_id IS NOT NULL)::INT)) + 1 AS idf
        FROM wld w CROSS JOIN kb k LEFT JOIN wdelta d ON d.world = w.world AND d.item_id = k.item_id""",
    "wnorm": """SELECT w.world, p.actor_id, sum(k.idf * k.idf) AS norm2 FROM wld w CROSS JOIN profile p JOIN wk k ON k.world = w.world AND k.item_id = p.item_id
        LEFT JOIN wdelta d ON d.world = w.world AND d.grp = p.actor_id AND d.item_id = p.item_id WHERE d.item_id IS NULL GROUP BY 1, 2""",
    "whit": """SELECT o.case_id, o.world, p.actor_id, sum(k.idf * k.idf) AS dot, sum(k.idf) AS matched FROM wobs o JOIN wk k ON k.world = o.world AND k.item_id = o.item_id
        JOIN profile p ON p.item_id = o.item_id LEFT JOIN wdelta d ON d.world = o.world AND d.grp = p.actor_id AND d.item_id = p.item_id WHERE d.item_id IS NULL GROUP BY 1, 2, 3""",
    "wown": "SELECT o.case_id, sum(k.idf * k.idf) AS obs2, sum(k.idf) AS obs FROM wobs o JOIN wk k ON k.world = o.world AND k.item_id = o.item_id GROUP BY 1",
    "wcos": """SELECT h.case_id, h.actor_id, h.dot / (sqrt(o.obs2) * sqrt(n.norm2)) AS cosine, h.matched / o.obs AS coverage
        FROM whit h JOIN wown o ON o.case_id = h.case_id JOIN wnorm n ON n.world = h.world AND n.actor_id = h.actor_id""",
    "wmark": "SELECT case_id, target AS actor_id FROM wcs WHERE target IS NOT NULL",
    "wsim": """SELECT case_id, actor_id, coalesce(cosine, 0) AS cosine, coalesce(coverage, 0) AS coverage, coalesce(cosine, 0) + 0.15 * coalesce(m, 0) AS score
        FROM wcos FULL JOIN (SELECT case_id, actor_id, 3 AS m FROM wmark) USING (case_id, actor_id)""",
    "wboth": """SELECT 'similarity' AS method, case_id, actor_id, score AS v FROM wsim UNION ALL SELECT 'coverage', case_id, actor_id, coverage FROM wsim
        UNION ALL SELECT 'hard', case_id, actor_id, cosine FROM wsim""",
    "wrank": """SELECT s.method, s.case_id, s.actor_id, s.v, c.setting, c.incident_id, c.grp, c.framed, c.target, row_number() OVER (PARTITION BY s.method, s.case_id ORDER BY round(s.v, 9) DESC, a.ord) AS rank
        FROM wboth s JOIN wcs c ON c.case_id = s.case_id JOIN actors a ON a.actor_id = s.actor_id WHERE c.setting <> 'open' OR s.actor_id <> c.grp""",
    "wout": """SELECT method, setting, incident_id, grp, "leading", CASE WHEN setting = 'open' THEN FALSE ELSE "leading" = grp END AS correct,
        setting IN ('false_flag', 'mimicry') AND "leading" = framed AS framed_named, top5, TRUE AS named, FALSE AS detected, p AS probability,
        CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.55 THEN 'moderate' ELSE 'low' END AS grade FROM (
        SELECT r.method, r.setting, r.incident_id, r.grp, r.framed, max(CASE WHEN rank = 1 THEN actor_id END) AS "leading", bool_or(rank <= 5 AND actor_id = r.grp) AS top5,
        1 / (sum(exp((v - m) / 0.05)) + ((SELECT count(*) FROM actors) - (r.setting = 'open')::INT - count(*)) * exp(-max(m) / 0.05)) AS p
        FROM wrank r JOIN (SELECT method, case_id, max(v) AS m FROM wrank GROUP BY 1, 2) t ON t.method = r.method AND t.case_id = r.case_id WHERE r.method <> 'hard'
        GROUP BY r.method, r.case_id, r.setting, r.incident_id, r.grp, r.framed)""",
    # What gate and abstention decide by.
    "wtop": """SELECT c.case_id, c.setting, c.incident_id, c.grp, c.framed, CAST(substr(c.grp, 2) AS BIGINT) % 2 AS fold, c.target AS visible, o.actor_id AS top, o.v AS hard, t.rank AS place
        FROM wcs c JOIN (SELECT * FROM wrank WHERE method = 'hard' AND rank = 1) o ON o.case_id = c.case_id
        LEFT JOIN (SELECT * FROM wrank WHERE method = 'hard') t ON t.case_id = c.case_id AND t.actor_id = c.target""",
    "outc": """SELECT l.doc_id AS id, d.source AS grp, CAST(regexp_extract(d.source, '(\\d+)$', 1) AS INT) % 2 AS fold, (d.n_chars * 7919) % 1000 / 1000.0::DOUBLE AS p,
        l.quality = 1 AS correct, l.toxic = 0 AS correct2 FROM labels l JOIN documents d USING (doc_id)""",
    "parts": """SELECT vec_id AS id, label AS truth, (embedding[1] > 0)::INT * 4 + (embedding[2] > 0)::INT * 2 + (embedding[3] > 0)::INT AS predicted FROM embeddings""",
    "ctab": "SELECT truth, predicted, count(*) AS n FROM parts GROUP BY 1, 2",
    # The adjusted Rand index over all rows (t = -1) and without each truth label.
    "rtab": "SELECT l.t, c.truth, c.predicted, c.n FROM (SELECT DISTINCT truth AS t FROM parts UNION ALL SELECT -1) l JOIN ctab c ON c.truth <> l.t",
    "rand": """SELECT s.t, (same - pt * pp / (n * (n - 1) / 2.0)) / ((pt + pp) / 2 - pt * pp / (n * (n - 1) / 2.0)) AS ari FROM
        (SELECT t, sum(n) AS n, sum(n * (n - 1) / 2.0) AS same FROM rtab GROUP BY 1) s
        JOIN (SELECT t, sum(n * (n - 1) / 2.0) AS pt FROM (SELECT t, truth, sum(n) AS n FROM rtab GROUP BY 1, 2) GROUP BY 1) a ON a.t = s.t
        JOIN (SELECT t, sum(n * (n - 1) / 2.0) AS pp FROM (SELECT t, predicted, sum(n) AS n FROM rtab GROUP BY 1, 2) GROUP BY 1) b ON b.t = s.t""",
    "bask": """SELECT DISTINCT 'E' || l_orderkey AS event_id, f.facet, f.value FROM lineitem,
        LATERAL (SELECT 'capability' AS facet, 'P' || l_partkey AS value UNION ALL SELECT 'infrastructure', 'S' || l_suppkey) f
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'E' || o_orderkey, 'victim', 'C' || o_custkey FROM orders""",
    "fw": """SELECT event_id AS id, facet || ':' || value AS feature, ln((1.0 + n) / (1.0 + df)) * (CASE WHEN facet = 'infrastructure' THEN 3 ELSE 1 END) AS w
        FROM bask JOIN (SELECT facet, value, count(*) AS df FROM bask GROUP BY 1, 2) USING (facet, value), (SELECT count(DISTINCT event_id) AS n FROM bask) WHERE df < n""",
    "tot": "SELECT id, sum(w) AS total FROM fw GROUP BY 1",
    "jac": """SELECT a, b, round(low / (x.total + y.total - low), 9) AS sim FROM
        (SELECT f.id AS a, g.id AS b, sum(least(f.w, g.w)) AS low FROM fw f JOIN fw g ON f.feature = g.feature AND f.id < g.id GROUP BY 1, 2)
        JOIN tot x ON x.id = a JOIN tot y ON y.id = b""",
    "gold": "SELECT doc_id, unnest(regexp_extract_all(lang || ' ' || source, '[a-z]+[0-9]*')) AS label FROM documents",
    "pred": "SELECT doc_id, unnest([CASE WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END, 'src' || (doc_id % 20 + (n_chars % 7 = 0)::INT)]) AS label FROM documents",
    "lcount": """SELECT label, count(*) FILTER (g.label IS NOT NULL AND p.label IS NOT NULL) AS tp, count(*) FILTER (g.label IS NULL) AS fp, count(*) FILTER (p.label IS NULL) AS fn
        FROM (SELECT DISTINCT * FROM gold) g FULL JOIN (SELECT DISTINCT * FROM pred) p USING (doc_id, label) GROUP BY 1""",
    "camp": """SELECT DISTINCT 'C:' || user_id || ':' || event_type || ':' || CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS campaign, 'G' || user_id AS grp,
        (CASE WHEN event_type IN ('purchase','signup') THEN 'S' ELSE 'T' END) || event_type || (k // 10) || '.' || (k % 10) AS target, strftime(ts, '%Y-%m-%d') AS reference FROM keyed""",
}
_WORLD = {
    # ACH in hold-out worlds. A case may stand in variants (thresholds, number of markers): xcs has their values, base is the case.
    "xcs": "SELECT case_id, case_id AS base, incident_id, grp, setting, framed, target, 3 AS n_marks, 0.15 AS cf, 13 AS rm FROM wcs",
    "xmarks": "SELECT case_id, target, unnest(range(1, n_marks + 1)) AS i FROM xcs WHERE target IS NOT NULL",
    "xrank": """SELECT x.case_id, s.actor_id, a.ord, row_number() OVER (PARTITION BY x.case_id ORDER BY round(s.cosine + 0.15 * coalesce(x.n_marks * (s.actor_id = x.target)::INT, 0), 9) DESC, a.ord) AS rank
        FROM xcs x JOIN wsim s ON s.case_id = x.base JOIN actors a ON a.actor_id = s.actor_id WHERE x.setting <> 'open' OR s.actor_id IS DISTINCT FROM x.grp""",
    "xcand": """SELECT case_id, actor_id, ord FROM xrank WHERE rank <= 8 UNION
        SELECT r.case_id, r.actor_id, r.ord FROM xrank r JOIN xcs x ON x.case_id = r.case_id WHERE r.actor_id = x.target""",
    "wu": """SELECT o.case_id, o.item_id, k.kind, k.usage AS u, k.n_groups AS n, greatest(k.usage - (d.item_id IS NOT NULL)::INT, 0) AS usage, k.n_groups - (w.setting = 'open')::INT AS n_groups
        FROM wobs o JOIN wcs w ON w.case_id = o.case_id JOIN kb k ON k.item_id = o.item_id LEFT JOIN wdelta d ON d.world = o.world AND d.item_id = o.item_id""",
    "xev": """SELECT x.case_id, 'E' || row_number() OVER (PARTITION BY x.case_id ORDER BY o.item_id) AS evidence_id, CASE WHEN o.item_id LIKE 'S%' THEN 'tool' ELSE 'ttp' END AS kind, o.item_id AS value,
        CAST(NULL AS VARCHAR) AS target, FALSE AS spoofable, 0.85 * 0.85 AS base_weight, coalesce((k.kind = 'ttp' AND k.u >= k.n * x.cf) OR (k.usage > 0 AND k.usage >= k.n_groups * x.cf), FALSE) AS is_common,
        coalesce(k.usage BETWEEN 1 AND x.rm, FALSE) AS is_rare, split_part(o.item_id, '.', 1) AS parent FROM xcs x JOIN wobs o ON o.case_id = x.base LEFT JOIN wu k ON k.case_id = x.base AND k.item_id = o.item_id
        UNION ALL SELECT case_id, 'M' || i, (['code_overlap','metadata','language_artifact','claim'])[((i - 1) % 4 + 1)::INT], '', target, TRUE, 0.85 * 0.85, FALSE, FALSE, '' FROM xmarks""",
    "xhas": """SELECT c.case_id, c.actor_id, p.item_id, p.parent FROM xcand c JOIN xcs x ON x.case_id = c.case_id JOIN wcs w ON w.case_id = x.base JOIN profile p ON p.actor_id = c.actor_id
        LEFT JOIN wdelta d ON d.world = w.world AND d.grp = c.actor_id AND d.item_id = p.item_id WHERE d.item_id IS NULL""",
    "xnear": "SELECT DISTINCT case_id, actor_id, parent FROM xhas WHERE item_id LIKE 'T%'",
}
_STATIC = ["acells", "hyps", "mat", "wts", "sums", "scored", "signs", "assessed", "graded"]
for _name in _STATIC:  # the rules of the static assessment, over the worlds' evidence, candidates and profiles
    _text = re.sub(r"\b(ev|cand|marks|profile|near|" + "|".join(_STATIC) + r")\b(?!\.)", lambda m: "x" + m[1].replace("profile", "has"), BLOCKS[_name])
    _WORLD["x" + _name] = _text.replace("ON p.actor_id", "ON p.case_id = e.case_id AND p.actor_id").replace("ON n.actor_id", "ON n.case_id = e.case_id AND n.actor_id")
BLOCKS |= _WORLD | {
    "xdec": """SELECT x.*, CASE WHEN g.leading_kind = 'actor' THEN g.leading_actor END AS "leading", CASE WHEN g.leading_kind = 'false_flag' THEN g.leading_actor END AS flagged FROM xcs x JOIN xgraded g ON g.case_id = x.case_id""",
    "xrec": "SELECT * FROM xdec",
}


def judged(table: str) -> str:
    """A table with leading and flagged, and what the decision is worth."""
    shown = "CASE WHEN setting = 'authentic' THEN grp WHEN setting IN ('false_flag', 'mimicry') THEN framed END"
    return f"""SELECT *, CASE WHEN setting = 'open' THEN "leading" IS NULL WHEN setting IN ('false_flag', 'mimicry') THEN named_true OR detected ELSE named_true END AS accuracy FROM (
SELECT *, coalesce("leading" = grp, FALSE) AS named_true, coalesce(flagged = {shown}, FALSE) AS detected, setting IN ('false_flag', 'mimicry') AND coalesce("leading" = framed, FALSE) AS framed_named,
"leading" IS NULL AND flagged IS NULL AS declined FROM {table})"""


BLOCKS["xrec"] = judged("xdec")
RATES = ", ".join(f"round(avg({c}::INT), 9) AS {c}" for c in ("accuracy", "named_true", "framed_named", "detected", "declined"))
_WORD = re.compile(r"\b[a-z_0-9]+\b")


def sql(final: str, **instead: str) -> str:
    """The statement with the blocks that it needs, each after those that it reads; `instead` replaces or adds blocks."""
    blocks, need = BLOCKS | instead, []

    def visit(text: str) -> None:
        for w in sorted(set(_WORD.findall(text)) & set(blocks)):
            if w not in need and re.search(rf"(?:FROM|JOIN|,|IN \(SELECT \* FROM)\s+\(?\s*{w}\b", text):
                visit(blocks[w])
                if w not in need:
                    need.append(w)

    visit(final)
    parts = [f"{k} AS ({blocks[k]})" for k in need]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final
