"""DuckDB SQL for every registered query, over the same tables.

The SQL is written on its own terms: plain joins, pair enumeration and grouped
sums, not a rendering of the Spark plans.
"""

from __future__ import annotations

from labelscope.domain import (
    BOX, CLASSES, FACE, FULL, METRICS, MODELS, PROMPT_FACE, PROMPT_FULL, PROMPT_REST, TASK_NAMES,
)
from labelscope.plans.fixtures import CROP_ROOT, ROOT, RUNS

_NAMES = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
_BOX = ", ".join(BOX)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _class_at(index: str) -> str:
    return f"{_NAMES}[({index}) % 26 + 1]"


_SUFFIX = "case when no % 5 = 0 then '' when no % 7 = 0 then '.tar.PNG' else '.jpg' end"

# Every seventh row or so names its file in another way.
_SPELLED = f"""case row_id % 7 when 1 then replace(image_path, '{ROOT}/', '{ROOT}/./')
    when 2 then replace(image_path, '{ROOT}/', '{ROOT}/skip/../')
    when 3 then '{ROOT}/' || replace(substr(image_path, {len(ROOT) + 2}), '/', '//') else image_path end"""

# A row of a crop is a stretch of the ramp 00 01 ... FF 00 01 ...
_RAMP = "repeat('" + "".join(f"{byte:02X}" for byte in range(256)) + "', 9)"
_DIGEST = f"""case when reason is null then md5(array_to_string(list_transform(range(y1, y2),
            lambda y: substr({_RAMP}, ((((y * w + x1) * 3 + no) % 256) * 2 + 1)::bigint, (x2 - x1) * 6)), '')) end"""

_CTES = {
    "classes": f"select unnest(range(26))::int as idx, unnest({_NAMES}) as cls",
    "numbered": "select *, event_id - event_id % 3 as no from events",
    "raw": f"""
        select event_id as row_id, event_type,
          concat(case when event_id % 17 = 0 then '  ' else '' end,
                 case when no % 37 = 1 then 'lost/' else 'img/' end,
                 no::varchar, {_SUFFIX}) as image_path,
          case when event_id % 29 = 0 then 'Boredom'
               when event_id % 31 = 0 then chr(9) || {_class_at('event_id')} || chr(160)
               else {_class_at('event_id')} end as label,
          ((event_id * 7 + user_id) % 420 - 40)::double + 0.5 as bbox_x1,
          ((event_id * 5 + user_id) % 300 - 30)::double as bbox_y1,
          ((event_id * 7 + user_id) % 420 - 40 + (event_id * 13) % 200 - 10)::double as bbox_x2,
          ((event_id * 5 + user_id) % 300 - 30 + (event_id * 11) % 150 - 5)::double as bbox_y2
        from numbered""",
    "images": f"""
        select concat('{ROOT}/img/', no::varchar, {_SUFFIX}) as image_path,
          (320 + 80 * (no % 5))::int as width, (240 + 60 * (no % 4))::int as height
        from (select distinct no from numbered)""",
    "contents": f"""
        select concat('{ROOT}/img/', no::varchar, {_SUFFIX}) as image_path, all_props as image
        from (select no, string_agg(props, '' order by event_id) as all_props from numbered group by no)""",
    "resolved": f"""
        select row_id, event_type, '{ROOT}/' || trim(image_path) as image_path,
          trim(label, chr(9) || chr(32) || chr(160)) as label, {_BOX}
        from raw""",
    "clean": """
        select row_id, event_type, image_path, label,
          trunc(bbox_x1)::bigint as bbox_x1, trunc(bbox_y1)::bigint as bbox_y1,
          trunc(bbox_x2)::bigint as bbox_x2, trunc(bbox_y2)::bigint as bbox_y2
        from resolved
        where image_path in (select image_path from images) and label in (select cls from classes)""",
    "cut_boxes": f"""
        select *, case when x2 <= x1 or y2 <= y1 then
            format('Bbox clamped to empty region ({{}},{{}},{{}},{{}})', x1, y1, x2, y2) end as reason
        from (select s.*, no, w, greatest(0, bbox_x1) as x1, greatest(0, bbox_y1) as y1,
                least(w, bbox_x2) as x2, least(h, bbox_y2) as y2
              from (select distinct image_path, {_BOX} from clean) s
              join (select distinct no, 320 + 80 * (no % 5) as w, 240 + 60 * (no % 4) as h,
                      concat('{ROOT}/img/', no::varchar, {_SUFFIX}) as image_path from numbered)
              using (image_path)
              where bbox_x2 > bbox_x1 and bbox_y2 > bbox_y1)""",
    "clamped": """
        select c.*, greatest(0, bbox_x1) as cut_x1, greatest(0, bbox_y1) as cut_y1,
          least(width, bbox_x2) as cut_x2, least(height, bbox_y2) as cut_y2
        from clean c join images using (image_path)""",
    "judged": """
        select *, case when bbox_x2 <= bbox_x1 or bbox_y2 <= bbox_y1 then 'invalid_bbox'
          when cut_x2 <= cut_x1 or cut_y2 <= cut_y1 then
            format('Bbox clamped to empty region ({},{},{},{})', cut_x1, cut_y1, cut_x2, cut_y2)
          end as crop_fail_reason
        from clamped""",
    "crops": f"""
        select *, crop_fail_reason is not null as crop_failed,
          case when crop_fail_reason is null then concat('{CROP_ROOT}/crop_',
            substr(md5(concat_ws('_', image_path, {_BOX})), 1, 12),
            case when ends_with(image_path, '.jpg') then '.jpg'
                 when ends_with(image_path, '.PNG') then '.PNG' else '.jpg' end) end as cropped_path
        from judged""",
    "runs": "select * from (values "
        + ", ".join(f"('{m}', '{c}', {s})" for m, c, s in RUNS)
        + ") t(model_key, context, shift)",
    "answers": f"""
        select c.*, model_key, context,
          case (row_id * 7 + shift) % 10
            when 0 then {_class_at('row_id')}
            when 1 then lower({_class_at('row_id')}) || '.'
            when 2 then 'The person shows ' || upper({_class_at('row_id')}) || ' clearly.'
            when 3 then {_class_at('row_id * 7 + 3')}
            when 4 then 'Not ' || {_class_at('row_id * 7 + 3')} || ' but ' || {_class_at('row_id')}
            when 5 then 'I cannot tell'
            when 6 then null
            when 7 then ' ..' || {_class_at('row_id * 7 + 3')} || '.. '
            when 8 then {_class_at('row_id')}
            else '' end as raw_output
        from crops c, runs where context = '{FULL}' or not crop_failed""",
    "texts": """
        select raw_output, lower(raw_output) as low, lower(trim(trim(raw_output), '.')) as bare
        from (select distinct raw_output from answers where raw_output is not null)""",
    "matches": f"""
        select raw_output, coalesce(list_filter({_NAMES}, lambda c: lower(c) = bare)[1],
          list_filter({_NAMES}, lambda c: contains(low, lower(c)))[1]) as cls
        from texts""",
    "results": """
        select a.*, coalesce(m.cls, 'Unknown') as predicted_label
        from answers a left join matches m using (raw_output)""",
    "shown": "select * from results where predicted_label <> 'Unknown'",
    "asked": "select distinct model_key, context from results",
    "class_counts": """
        select r.model_key, r.context, c.idx, c.cls,
          (select count(*) from shown s where s.model_key = r.model_key and s.context = r.context
             and s.label = c.cls) as support,
          (select count(*) from shown s where s.model_key = r.model_key and s.context = r.context
             and s.predicted_label = c.cls) as predicted,
          (select count(*) from shown s where s.model_key = r.model_key and s.context = r.context
             and s.label = c.cls and s.predicted_label = c.cls) as hits
        from asked r cross join classes c""",
    "class_scores": """
        select *, case when predicted = 0 then 0.0::double else hits::double / predicted end as p,
          case when support = 0 then 0.0::double else hits::double / support end as r,
          case when support + predicted = 0 then 0.0::double
            else 2.0::double * hits / (support + predicted) end as f
        from class_counts""",
    "averages": """
        select model_key, context, sum(support)::bigint as total,
          case when sum(support) = 0 then 0.0::double else sum(hits)::double / sum(support)::double end as accuracy,
          avg(p) as precision_macro, avg(r) as recall_macro, avg(f) as f1_macro,
          case when sum(support) = 0 then 0.0::double
            else sum(p * support) / sum(support)::double end as precision_weighted,
          case when sum(support) = 0 then 0.0::double
            else sum(r * support) / sum(support)::double end as recall_weighted,
          case when sum(support) = 0 then 0.0::double
            else sum(f * support) / sum(support)::double end as f1_weighted
        from class_scores group by model_key, context""",
    "metrics": "select model_key, context, "
        + ", ".join(f"round_even({m}, 4) as {m}" for m in METRICS)
        + " from averages",
    "cells": """
        select g.model_key, g.context, t.idx as true_idx, p.idx as pred_idx, count(s.row_id) as n
        from asked g cross join classes t cross join classes p
        left join shown s on s.model_key = g.model_key and s.context = g.context
          and s.label = t.cls and s.predicted_label = p.cls
        group by all""",
    "models": "select * from (values "
        + ", ".join(f"({i}, '{m[0]}', '{m[1]}')" for i, m in enumerate(MODELS))
        + ") t(ord, model_key, name)",
    "full_rows": f"select * from results where context = '{FULL}'",
    "face_rows": f"select * from results where context = '{FACE}'",
    "pairs": """
        select f.model_key, f.row_id, f.image_path, f.bbox_x1, f.bbox_y1, f.bbox_x2, f.bbox_y2, f.label,
          f.predicted_label as predicted_label_full, c.predicted_label as predicted_label_face, c.cropped_path
        from full_rows f join (
          select * from face_rows qualify row_number() over (
            partition by model_key, image_path, bbox_x1, bbox_y1, bbox_x2, bbox_y2 order by row_id) = 1) c
        using (model_key, image_path, bbox_x1, bbox_y1, bbox_x2, bbox_y2)""",
    "image_pairs": """
        select f.model_key, f.row_id, f.image_path, f.label, c.row_id as face_row_id, c.cropped_path,
          f.predicted_label as predicted_label_full, c.predicted_label as predicted_label_face
        from full_rows f join face_rows c using (model_key, image_path)""",
    "stored": f"""
        select * from results where model_key = 'qwen' and context = '{FULL}'
          and event_type in ('view', 'click')""",
    "replies": f"""
        select image_path, context, n % 13 = 0 as refused, n,
          case when n % 13 <> 0 then ' ' || lower({_NAMES}[(n + shift) % 26 + 1]) || '. ' end as raw_output,
          case when n % 13 <> 0 then {_NAMES}[(n + shift) % 26 + 1] else 'Unknown' end as predicted_label,
          case when n % 13 = 0 then 'cannot look at ' || n::varchar end as error
        from (select image_path, regexp_replace(image, '[^0-9]', '', 'g')::bigint as n from contents),
          (values ('{FULL}', 1), ('{FACE}', 5)) c(context, shift)""",
}

_SAME_PERSON = " and ".join(f"s.{c} = c.{c}" for c in ("image_path", *BOX))
_HELPED = "predicted_label_full = label and predicted_label_face <> label"
_HURT = "predicted_label_full <> label and predicted_label_face = label"


def _first_pairs(source: str, condition: str, order: str, n: int = 6) -> str:
    return f"""
        select * from (select *, (row_number() over (partition by model_key order by {order}))::int as rank
          from {source} where {condition}) where rank <= {n}"""


def _case_counts(source: str) -> str:
    return f"""
        select model_key, count(*) as n_pairs, count(*) filter (where {_HELPED}) as n_helped,
          count(*) filter (where {_HURT}) as n_hurt
        from {source} group by model_key"""


def _centroid(dims: int, context: str) -> str:
    return f"""
        select v.vec_id, v.label, '{context}' as context,
          arg_min(cls, (d, k)) as raw_output, arg_min(cls, (d, k)) as predicted_label
        from (select v.vec_id, v.label, c.label as k,
                list_sum(list_transform(range(1, {dims} + 1),
                  lambda i: (v.embedding[i]::double - c.center[i]) ** 2)) as d
              from embeddings v, (
                select label, list(m order by i) as center from (
                  select label, i, avg(embedding[i]::double) as m
                  from embeddings, range(1, {dims} + 1) r(i) group by label, i)
                group by label) c) v
        join classes on idx = k
        group by v.vec_id, v.label"""


_PROMPTS = {c: _text(p + PROMPT_REST) for c, p in ((FULL, PROMPT_FULL), (FACE, PROMPT_FACE))}

_SELECTS = {
    "clean_annotations": f"""
        select c.row_id, {_SPELLED} as image_path, c.image_path as image_key, c.label, {_BOX}, c.event_type
        from clean c""",
    "csv_order": """
        select row_number() over (order by case when event_id % 10 = 0 then 0 when event_id % 10 <= 8 then 1 else 2 end,
          event_id) - 1 as row_id, event_id as n from events""",
    "load_audit": """
        select count(*) as raw_rows, count(*) filter (where not found) as missing_images,
          count(*) filter (where found and not known) as unknown_labels,
          count(*) filter (where found and known) as usable_rows,
          least(count(*) filter (where found and known), 500) as subset_rows
        from (select image_path in (select image_path from images) as found,
                label in (select cls from classes) as known from resolved)""",
    "sample_n": f"""
        select row_id, image_path, label, {_BOX} from clean
        order by md5(concat('42_', row_id::varchar)), row_id limit 500""",
    "sample_large": f"""
        select row_id, image_path, label, {_BOX} from clean
        order by md5(concat('42_', row_id::varchar)), row_id limit 500""",
    "crop_plan": f"""
        select row_id, image_path, {_BOX}, cropped_path, crop_failed, crop_fail_reason from crops""",
    "crop_regions": """
        select row_id, cropped_path, cut_x1, cut_y1, cut_x2, cut_y2 from crops where not crop_failed""",
    "cut_pixels": f"""
        select image_path, {_BOX}, reason as crop_fail_reason,
          case when reason is null then (x2 - x1)::int end as width,
          case when reason is null then (y2 - y1)::int end as height, {_DIGEST} as digest
        from cut_boxes""",
    "crop_store": f"""
        select image_path, {_BOX}, (x2 - x1)::int as width, (y2 - y1)::int as height, {_DIGEST} as digest,
          'crop_' || substr(md5(concat_ws('_', image_path, {_BOX})), 1, 12) as stem
        from cut_boxes where reason is null""",
    "face_scores": f"""
        select row_id, image_path, {_BOX}, case when c.no is not null and c.reason is null
            then 'I see ' || {_class_at('((y1 * w + x1) * 3 + no) % 256')} end as raw_output,
          case when c.no is not null and c.reason is null
            then {_class_at('((y1 * w + x1) * 3 + no) % 256')} else 'Unknown' end as predicted_label
        from (select row_id, image_path, {_BOX} from clean) left join cut_boxes c using (image_path, {_BOX})""",
    "full_scores": f"""
        select c.row_id, model_key, 1 as attempt, 'I see ' || {_class_at('(c.row_id - c.row_id % 3) % 256 + ord')} as raw_output,
          {_class_at('(c.row_id - c.row_id % 3) % 256 + ord')} as predicted_label, null::varchar as error
        from clean c cross join models where model_key = 'internvl' or c.event_type <> 'view'""",
    "csv_annotations": f"""
        select row_id, image_path, label, {_BOX}, concat('said "', event_type, '", or so') as note,
          nullif(event_type, 'view') as kind from clean""",
    "incremental_scores": f"""
        select row_id, image_path, label, raw_output, predicted_label, error,
          'qwen' as model_key, '{FULL}' as context
        from clean join replies using (image_path) where context = '{FULL}'""",
    "metrics_stored": "select * from metrics",
    "crop_failures": f"select image_path, label, crop_fail_reason, {_BOX} from crops where crop_failed",
    "crop_audit": """
        select case when crop_fail_reason is null then 'ok'
            when crop_fail_reason = 'invalid_bbox' then 'invalid_bbox' else 'clamped_empty' end as outcome,
          count(*) as n_rows from crops group by outcome""",
    "crop_cache": f"""
        select row_id, image_path, {_BOX}, exists (
            select 1 from crops s where not crop_failed and event_type in ('view', 'click') and {_SAME_PERSON}
          ) as cached
        from clean c where bbox_x2 > bbox_x1 and bbox_y2 > bbox_y1""",
    "resize_plan": """
        select image_path, width, height,
          case when greatest(width, height) > 512
            then trunc(width * (512::double / greatest(width, height)))::bigint else width end as new_width,
          case when greatest(width, height) > 512
            then trunc(height * (512::double / greatest(width, height)))::bigint else height end as new_height
        from (select image_path, (width * (1 + height % 7) + length(image_path))::int as width,
                (height * (1 + width % 9) + length(image_path))::int as height from images)""",
    "prompts": f"""
        select row_id, context, case when context = '{FULL}' then {_PROMPTS[FULL]} else {_PROMPTS[FACE]} end as prompt
        from clean, (values ('{FULL}'), ('{FACE}')) c(context)""",
    "request_payloads": f"""
        select image_path, to_json(struct_pack(model := 'llava-phi3', prompt := {_PROMPTS[FULL]},
            images := [base64(image::blob)], stream := false,
            options := struct_pack(temperature := 0, num_predict := 20)))::varchar as payload
        from contents""",
    "parse_labels": "select row_id, model_key, context, raw_output, predicted_label from results",
    "answered": "select row_id, model_key, context, label, predicted_label from shown",
    "score_status": f"""
        select row_id, {_SPELLED} as image_path, image_path in (select image_path from images) as scorable from resolved""",
    "score_rows": """
        select row_id, context, raw_output, predicted_label, error from clean join replies using (image_path)""",
    "score_centroid": _centroid(64, FULL) + " union all " + _centroid(16, FACE),
    "resume_remaining": f"""
        select row_id, image_path, {_BOX} from clean c
        where not exists (select 1 from stored s where {_SAME_PERSON})""",
    "resume_by_image": f"""
        select row_id, image_path, {_BOX} from clean c where not exists (
          select 1 from stored s where s.image_path = c.image_path and s.predicted_label <> 'Unknown')""",
    "resume_audit": f"""
        select (select count(*) from stored) as stored_rows, (select count(*) from clean c
          where not exists (select 1 from stored s where {_SAME_PERSON})) as remaining_rows""",
    "resume_union": f"""
        select row_id, image_path, label, raw_output, predicted_label from stored
        union all
        select row_id, image_path, label, raw_output, predicted_label
        from clean c join replies using (image_path)
        where context = '{FULL}' and not exists (select 1 from stored s where {_SAME_PERSON})""",
    # An image that the first run cannot read (n % 11 = 3) is read by the second unless its rows come
    # only then; one the second cannot read (5) has rows from the first, or from the third. What the
    # third cannot read (7) it has not been asked about.
    "resume_retry": f"""
        select c.row_id, model_key, '{FULL}' as context,
          case when c.event_type <> 'click' and no % 11 = 3 then 2 when c.event_type = 'click' and no % 11 = 5 then 2 else 1 end
            as attempt, raw_output, predicted_label, error
        from (select *, row_id - row_id % 3 as no from clean) c join replies using (image_path),
          (values ('qwen'), ('llava')) m(model_key) where context = '{FULL}'""",
    "confusion_dense": "select * from cells",
    "confusion_norm": """
        select model_key, context, true_idx, pred_idx,
          n::double / greatest(sum(n) over (partition by model_key, context, true_idx), 1)::double as rate
        from cells""",
    "confusion_reload": f"""
        select model_key, context, true_idx, pred_idx, case when context = '{FULL}' then n else 0 end as n
        from cells""",
    "metrics_all": "select * from metrics",
    "metrics_empty": "select model_key, context, "
        + ", ".join(f"coalesce(m.{m}, 0.0) as {m}" for m in METRICS)
        + f""" from models cross join (values ('{FULL}'), ('{FACE}')) c(context)
          left join (select * from metrics where model_key = 'qwen' and context = '{FULL}') m
          using (model_key, context)""",
    "run_notes": f"""
        select m.model_key, c.context, count(s.row_id) as answered, count(s.row_id) filter (where s.label = s.predicted_label) as correct,
          case when count(s.row_id) = 0 then 'No valid predictions.' end as note
        from models m cross join (values ('{FULL}'), ('{FACE}')) c(context)
        left join (select * from shown where model_key <> 'llava') s using (model_key, context) group by all""",
    "metrics_by_batch": "select model_key, context, "
        + ", ".join(f"coalesce(m.{m}, 0.0) as {m}" for m in METRICS)
        + f""" from models cross join (values ('{FULL}'), ('{FACE}')) c(context) left join metrics m using (model_key, context)""",
    "class_report": """
        select model_key, context, idx as position, cls as name, round_even(p, 2) as "precision",
          round_even(r, 2) as recall, round_even(f, 2) as f1, support from class_scores
        union all
        select model_key, context, 26, 'accuracy', null, null, round_even(accuracy, 2), total from averages
        union all
        select model_key, context, 27, 'macro avg', round_even(precision_macro, 2),
          round_even(recall_macro, 2), round_even(f1_macro, 2), total from averages
        union all
        select model_key, context, 28, 'weighted avg', round_even(precision_weighted, 2),
          round_even(recall_weighted, 2), round_even(f1_weighted, 2), total from averages""",
    "comparison": f"""
        select ord, case when context = '{FULL}' then 0 else 1 end as task_ord, name as "Model",
          case when context = '{FULL}' then '{TASK_NAMES[FULL]}' else '{TASK_NAMES[FACE]}' end as "Task",
          accuracy as "Accuracy", precision_macro as "Prec(M)", recall_macro as "Rec(M)",
          f1_macro as "F1(M)", f1_weighted as "F1(W)"
        from models join metrics using (model_key)""",
    "f1_compare": f"""
        select ord, model_key, name, a.f1_macro as f1_full, coalesce(b.f1_macro, 0.0) as f1_face
        from models join (select * from metrics where context = '{FULL}') a using (model_key)
        left join (select * from metrics where context = '{FACE}') b using (model_key)""",
    "recall_compare": f"""
        select ord, model_key, name, idx, cls, a.r as recall_full, coalesce(b.r, 0.0) as recall_face
        from models join (select * from class_scores where context = '{FULL}') a using (model_key)
        left join (select model_key, idx, r from class_scores where context = '{FACE}') b
          using (model_key, idx)""",
    "context_pairs": """
        select model_key, row_id, label, predicted_label_full, predicted_label_face, cropped_path
        from pairs""",
    "context_cases": _case_counts("pairs"),
    "context_helped": _first_pairs("pairs", _HELPED, "row_id"),
    "context_hurt": _first_pairs("pairs", _HURT, "row_id"),
    "context_helped_long": _first_pairs("pairs", _HELPED, "row_id", 5000),
    "context_pairs_by_image": """
        select model_key, row_id, image_path, label, predicted_label_full, count(*) as n_pairs,
          count(*) filter (where predicted_label_face = label) as n_face_right
        from image_pairs group by all""",
    "context_cases_by_image": _case_counts("image_pairs"),
    "context_helped_by_image": _first_pairs("image_pairs", _HELPED, "row_id, face_row_id"),
    "context_hurt_by_image": _first_pairs("image_pairs", _HURT, "row_id, face_row_id"),
    "sample_per_label": """
        select idx, label, replace(label, '/', '_') as file_label, row_id, image_path, cropped_path
        from face_rows f join classes on cls = label join models using (model_key)
        where ord = (select min(ord) from face_rows join models using (model_key))
        qualify row_number() over (partition by label order by row_id) = 1""",
}


def oracle_sql() -> dict[str, str]:
    """Query name to a self-contained statement."""
    ctes = ",\n".join(f"{name} as ({body})" for name, body in _CTES.items())
    return {name: f"with {ctes}\n{body}" for name, body in _SELECTS.items()}
