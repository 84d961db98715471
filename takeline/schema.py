"""Table schemas; every reader takes one of these, nothing is inferred."""

FRAME_LISTING = "clip_id string, source string, priority int, file_name string"
SPAN = "clip_id string, date string, start_ms long, first_frame int, end_ms long, last_frame int"
TAKE = "clip_id string, take_id string, position int, take_size int, date string, seconds double, frame int"
PROBABILITIES = "clip_id string, p array<double>"
PRIOR = "prev int, next int, p double"
FOLD = "clip_id string, fold int, user string, action_id int"
TEMPLATE = "row_no int, path string, prediction int"
DETECTION = "clip_id string, probe int, x1 double, y1 double, x2 double, y2 double, score double"
WINDOW = "clip_id string, top int, left int, bottom int, right int, n_detected int, source string, best_score double"
MANIFEST = "key string, dtype string, shape array<long>, elements long, sha256 string"
IMU = "clip_id string, device string, t_idx long, ch array<double>"

#: Classes of a probability vector, and the floor below which logs are not taken.
CLASSES = 40
FLOOR = 1e-12
