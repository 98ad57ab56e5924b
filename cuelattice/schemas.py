"""Explicit schemas of the data model; nothing is inferred."""

from __future__ import annotations

PARAMS = (
    "effect_id STRING, pos INT, name STRING, label STRING, kind STRING, default_value STRING, lo DOUBLE, hi DOUBLE, step DOUBLE, "
    "choices ARRAY<STRING>, unit STRING, descr STRING, grp STRING, iscale BOOLEAN, fmt STRING"
)
CUES = (
    "clip_id STRING, id STRING, start_frame BIGINT, dur_frames BIGINT, text STRING, pos_x DOUBLE, pos_y DOUBLE, align STRING, "
    "color STRING, size DOUBLE, italic BOOLEAN"
)
EVENT_EDITS = (
    "job_id STRING, layer_pos INT, op_pos INT, op STRING, id STRING, t DOUBLE, effect STRING, kind STRING, detail MAP<STRING,STRING>"
)
PLANNED_EVENTS = (
    "job_id STRING, layer_pos INT, effect STRING, kind STRING, id STRING, t DOUBLE, dur DOUBLE, detail MAP<STRING,STRING>"
)

# The nested catalog document: ``chain`` steps keep their order by ``pos``.
STEP = "STRUCT<pos: BIGINT, which: STRING, effect_id: STRING, params: ARRAY<STRUCT<param: STRING, value: STRING>>>"
CATALOG_DOC = f"job BIGINT, part BIGINT, chain ARRAY<{STEP}>"

CATALOG_FILE = (
    "version STRING, "
    "effects MAP<STRING, STRUCT<id: STRING, label: STRING, kind: STRING, `desc`: STRING, params: ARRAY<STRUCT<name: STRING, label: STRING, "
    "kind: STRING, default: STRING, lo: DOUBLE, hi: DOUBLE, step: DOUBLE, choices: ARRAY<STRING>, unit: STRING, `desc`: STRING, "
    "`group`: STRING, iscale: BOOLEAN, fmt: STRING>>>>, "
    "presets MAP<STRING, STRUCT<id: STRING, name: STRING, family: STRING, era: STRING, `desc`: STRING, tagline: STRING, tags: ARRAY<STRING>, "
    "proc_height: INT, upscale: STRING, video: ARRAY<STRING>, audio: ARRAY<STRING>, "
    "variants: ARRAY<STRUCT<id: STRING, name: STRING, `desc`: STRING, video: MAP<STRING, STRING>, audio: MAP<STRING, STRING>>>>>"
)

PROBE_DOC = (
    "STRUCT<streams: ARRAY<STRUCT<codec_type: STRING, disposition: STRUCT<attached_pic: INT>, avg_frame_rate: STRING, r_frame_rate: STRING, "
    "nb_frames: STRING, width: INT, height: INT, duration: STRING, sample_rate: STRING, channels: INT, color_space: STRING>>, "
    "format: STRUCT<duration: STRING>>"
)
EDIT_DOC = "STRUCT<op: STRING, id: STRING, t: DOUBLE, effect: STRING, kind: STRING, detail: MAP<STRING, STRING>>"
LAYER_DOC = (
    "ARRAY<STRUCT<preset: STRING, variant: STRING, enabled: BOOLEAN, sets: MAP<STRING, STRING>, seed: BIGINT, intensity: DOUBLE, "
    "texture: DOUBLE, events: ARRAY<STRING>>>"
)
