"""Fixed schemas; nothing is inferred."""

TRANSCRIPTS = (
    "session_id string, success boolean, text string, raw_text string, tokens array<string>, token_timestamps array<float>, "
    "duration float, inference_latency float, confidence float, error string"
)
FRAMES = "stream_id string, pos long, ts timestamp, samples array<smallint>"
#: Blocks as they lie in a topic: format f32, i16 or u16, little-endian, channels interleaved.
BLOCKS = "stream_id string, pos long, ts timestamp, format string, channels int, rate int, data binary"
CAPTURE_EVENTS = "stream_id string, ts timestamp, seq long, role string, action string"
UPDATES = "session_id string, sequence int, text string, tokens array<string>, committed_prefix_chars int, final_result boolean"
DATASET = "id string, text string, raw_text string, duration float, sample_rate int, inference_latency float, confidence float, timestamp timestamp, day date"
