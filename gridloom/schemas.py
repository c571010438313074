"""Schemas of the logical tables. Readers state them, nothing is inferred."""

RASTER = "image_id string, x int, y int, v double"
PACKED = "image_id string, nx int, ny int, data array<double>"
RGB = "image_id string, x int, y int, r double, g double, b double"
VOLUME = "image_id string, x int, y int, z int, v double"
LAYERS = "image_id string, level int, x int, y int, fg boolean"
KEYPOINTS = "image_id string, kp_id long, x double, y double, response double"
SIGNAL = "series_id string, idx int, v double"
BYTES = "doc_id long, pos int, byte int"
ENDPOINTS = "image_id string, level int, x int, y int, saliency double, norm_dt double, distance double"
EDGES = "src long, dst long, len int"
