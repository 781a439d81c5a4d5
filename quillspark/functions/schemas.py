"""Schemas of the records, as DDL. No reader infers a schema."""

SEGMENTS = "clip_id string, path string, start_ms int, end_ms int, duration_sec double, dialect string, domain string, source_id string, source_path string, source_bucket string, source_root string"
RECOGNISED = (
    "text string, avg_no_speech_prob double, segments array<struct<id:int,start:double,end:double,text:string,no_speech_prob:double,"
    "words:array<struct<word:string,start:double,end:double,probability:double>>>>"
)
TRANSCRIPTS = (
    "clip_id string, audio_path string, duration_sec double, transcript string, word_tags array<struct<word:string,lang:string,start:double,end:double>>, clip_label string, is_code_switched boolean, "
    "bn_ratio double, en_ratio double, en_word_count int, bn_word_count int, switch_count int, cs_confidence string, avg_no_speech_prob double, needs_human_review boolean, human_transcript string, "
    "dialect string, domain string, source_id string, source_path string, source_bucket string, source_root string"
)
REVIEWED = TRANSCRIPTS + ", annotation_tier string"
MANIFEST = "clip_id string, source_id string, audio_path string, transcript string, normalized_transcript string, dialect string, domain string, is_code_switched boolean, bn_ratio double, en_ratio double, duration_sec double, word_tags string"
PREDICTIONS = "clip_id string, audio_path string, reference string, hypothesis string, dialect string, domain string, is_code_switched boolean, bn_ratio double, en_ratio double, duration_sec double"
VALIDATION = "clip_id string, dialect string, is_code_switched string, audio_path string, silver_transcript string, human_transcript string"
DUPLICATES = "clip_id string, kept_from string, skipped_from string"
TRAINER_STATE = "global_step int, log_history array<struct<step:int,loss:double,eval_loss:double,eval_wer:double>>"
CATALOGUE = "map<string,struct<dialect:string,domain:string,queries:array<string>>>"
SCORES = "map<string,struct<wer_overall:double,cer_overall:double,wer_cs_subset:double,mix_er:double,cs_f1:double>>"
PUBLIC = ("clip_id", "transcript", "normalized_transcript", "dialect", "domain", "is_code_switched", "bn_ratio", "en_ratio", "duration_sec", "split")
REVIEW_SHEET = ("clip_id", "audio_path", "dialect", "domain", "duration_sec", "transcript", "human_transcript", "clip_label", "is_code_switched", "bn_ratio", "en_ratio", "switch_count", "avg_no_speech_prob")
#: Columns of the reviewers' sheet in their order, and what stands for a missing value.
REVIEW_LAYOUT = {
    "clip_id": "", "audio_path": "", "duration_sec": "", "auto_transcript": "", "is_code_switched": "false", "dialect": "", "domain": "General", "bn_ratio": "0.0", "en_ratio": "0.0",
    "cs_confidence": "NONE", "switch_count": "0", "human_transcript": "", "notes": "",
}
