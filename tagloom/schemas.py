"""Table schemas."""

from __future__ import annotations

POSTS = (
    "id bigint, general string, character string, copyright string, rating string, score int, "
    "image_width int, image_height int, created_at string"
)
TAG_GROUPS = "group_name string, tag string"
VOCABULARY = "token_id int, token string, kind string, cnt bigint"
CLUSTER_MAP = "token string, cluster_id int"
TAG_VECTORS = "token_id int, token string, embedding array<float>"
PREPARED = "id bigint, text string, input_ids array<int>"
