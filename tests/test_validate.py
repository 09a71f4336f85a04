import pytest

from turnweave.operators import timeline
from turnweave.operators.validate import validate_segments, with_validation

PHRASE = "ご視聴ありがとうございました"
SEGMENTS = (
    "media_id string, seg_index int, start double, end double, text string, avg_logprob double, "
    "no_speech_probability double"
)


def judge(spark, segments, ranges, turns):
    seg = spark.createDataFrame([("m", *row) for row in segments], SEGMENTS)
    span = spark.createDataFrame([("m", *row) for row in ranges], "media_id string, start double, end double")
    turn = spark.createDataFrame(
        [("m", n, *row) for n, row in enumerate(turns)],
        "media_id string, turn_pos int, start double, end double, speaker string",
    )
    return validate_segments(seg, span, turn)


def test_phrase_outside_speech_is_rejected(spark):
    rows = [(n, s, s + 2.0, PHRASE, -0.3, 0.1) for n, s in enumerate((176.44, 206.44, 236.44), start=1)]
    found = judge(spark, rows, [(0.0, 160.0)], []).orderBy("seg_index").collect()
    assert [r.state for r in found] == ["rejected"] * 3
    assert found[0].reasons == [
        "no_speech_candidate_overlap", "no_speaker_overlap", "known_silence_hallucination_phrase",
        "repeated_hallucination_phrase", "consecutive_hallucination_phrase",
    ]


def test_single_phrase_inside_speech_is_kept(spark):
    found = judge(spark, [(1, 2.0, 4.0, PHRASE, -0.1, 0.01)], [(1.0, 5.0)], [(1.0, 5.0, "SPEAKER_00")]).head()
    assert (found.state, found.reasons, found.speech_overlap) == ("validated", [], 2.0)


def test_long_repeated_phrase_is_rejected_despite_a_speaker(spark):
    rows = [(n, (n - 1) * 30.0, n * 30.0, PHRASE, -0.1, 0.2) for n in (1, 2, 3)]
    found = judge(spark, rows, [(0.0, 90.0)], [(0.0, 90.0, "SPEAKER_00")]).collect()
    assert {r.state for r in found} == {"rejected"}
    assert found[0].reasons == [
        "known_silence_hallucination_phrase", "repeated_hallucination_phrase", "consecutive_hallucination_phrase",
        "long_known_hallucination_segment",
    ]


@pytest.mark.parametrize(
    ("row", "state", "reasons"),
    [
        ((1, 0.0, 0.05, "hi", -0.1, 0.1), "rejected", ["no_speech_candidate_overlap"]),
        ((1, 0.0, 2.0, "hi", -0.7, 0.1), "validated", ["low_confidence"]),
        ((1, 0.0, 2.0, "hi", None, 0.6), "rejected", ["high_no_speech_probability"]),
        ((1, 0.0, 2.0, "hi", -0.6, None), "validated", []),
    ],
)
def test_single_rules(spark, row, state, reasons):
    found = judge(spark, [row], [(0.0, 5.0)], [(0.0, 5.0, "A")]).head()
    assert (found.state, found.reasons) == (state, reasons)


def test_document_form(spark):
    rows = with_validation(judge(spark, [(1, 0.0, 2.0, "hi", -0.1, 0.9)], [(0.5, 1.23456)], [])).head()
    assert rows.validation.speech_overlap_sec == 0.735
    assert rows.rejection_reasons == ["no_speaker_overlap", "high_no_speech_probability"]


def test_timeline(spark):
    judged = judge(spark, [(4, 2.0, 4.5, "こんにちは", -0.1, 0.1)], [(2.0, 4.5)], [(2.0, 4.0, "SPEAKER_01")])
    sources = spark.createDataFrame(
        [("m", "2026-03-25T23:59:58+09:00"), ("n", None)], "media_id string, recorded_at string"
    )
    turns = timeline.timeline_turns(judged, sources)
    turn = turns.head()
    assert (turn["index"], turn.speaker, turn.text, turn.transcription_segment_index) == (1, "SPEAKER_01", "こんにちは", 4)
    assert turn.absolute_start_at == "2026-03-26T00:00:00+09:00"
    assert turn.absolute_end_at == "2026-03-26T00:00:02.500000+09:00"
    described = sources.selectExpr("media_id", "struct(recorded_at) as source", "struct('v' as pipeline_version) as pipeline")
    documents = {d.media_id: d for d in timeline.timeline_documents(turns, described).collect()}
    assert documents["m"].turn_count == 1 and len(documents["m"].turns) == 1
    assert documents["n"].turn_count == 0 and documents["n"].turns == []
    assert timeline.require_same_text(judged, turns).head().changed == 0
    changed = turns.withColumn("text", turns.text.substr(1, 2))
    assert timeline.changed_texts(judged, changed).count() == 1
    with pytest.raises(Exception, match="Transcript text was changed"):
        timeline.require_same_text(judged, changed).collect()


def test_long_recordings_become_several_parts(spark):
    rows = [(n, float(n), n + 0.9, f"t{n}", -0.1, 0.1) for n in range(1, 8)]
    judged = judge(spark, rows, [(0.0, 10.0)], [(0.0, 10.0, "A")])
    parts = timeline.turn_parts(timeline.timeline_turns(judged), per_part=3).orderBy("part").collect()
    assert [len(p.turns) for p in parts] == [3, 3, 1]
    assert {(p.parts, p.turn_count) for p in parts} == {(3, 7)}
    assert [t["index"] for p in parts for t in p.turns] == list(range(1, 8))
