"""Fixed values of the content rules; every operator takes its own as parameters."""

# Topic keywords.
TOPIC_KEYWORDS = [
    "ai", "artificial intelligence", "machine learning", "deep learning", "neural network", "large language model", "llm", "llms", "generative ai",
    "genai", "chatbot", "foundation model", "multimodal model", "transformer model", "ai model", "ai agent", "ai system", "ai startup", "ai chip",
    "ai regulation", "gpt", "chatgpt", "openai", "anthropic", "claude", "gemini", "copilot", "midjourney", "stable diffusion", "hugging face",
    "deepmind", "nvidia ai", "ml", "mlops", "reinforcement learning", "supervised learning", "unsupervised learning", "self-supervised",
    "self supervised", "transfer learning", "federated learning", "fine-tuning", "fine tuning", "training run", "inference", "embedding",
    "embeddings", "diffusion model", "vision model", "computer vision", "natural language processing", "nlp", "speech recognition", "benchmark",
    "dataset", "gpu cluster", "tpu", "robot", "robots", "robotic", "robotics", "humanoid", "cobot", "autonomous vehicle", "self-driving",
    "self driving", "drone", "drones", "uav", "manipulation", "actuator", "lidar", "slam", "teleoperation", "exoskeleton", "quadruped",
    "swarm robotics", "embodied ai", "robot learning", "motion planning", "warehouse automation",
]

# Priority signals (pattern over lower-cased text, weight).
PRIORITY_SIGNALS = (
    (r"\b(breaking|urgent|just in|today)\b", 0.30),
    (r"\b(world[ -]?first|first ever|record[- ]breaking|unprecedented|breakthrough)\b", 0.35),
    (r"\b(launch(?:es|ed)?|release[ds]?|introduc(?:es|ed|ing)|general availability)\b", 0.20),
    (r"\b(security|vulnerability|breach|safety|ban(?:ned)?|regulation|lawsuit)\b", 0.25),
    (r"\b(acquisition|funding|investment|partnership|billion)\b", 0.15),
)

# Words left out of overlaps; trust of extractors.
STOPWORDS = "the a an and or of to in on for is with at by".split()
HIGH_TRUST_EXTRACTORS = ["og_meta", "rss_enclosure", "api_payload", "json_ld"]
MEDIUM_TRUST_EXTRACTORS = ["rss_media_content", "html_picture", "html_img", "twitter_card"]

# Weights of relevance and quality.
RELEVANCE_WEIGHTS = {"overlap": 0.4, "position": 0.3, "trust": 0.3}
QUALITY_WEIGHTS = {"relevance": 0.25, "resolution": 0.15, "visual": 0.15, "source": 0.15, "platform": 0.10, "uniqueness": 0.10, "aspect": 0.10}
IDEAL_ASPECT = 1.91
IDEAL_PIXELS = 1920 * 1080

# Signs of images that aren't content.
AVATAR_HOSTS = ["cdn-avatars.huggingface.co", "avatars.githubusercontent.com", "secure.gravatar.com", "gravatar.com", "pbs.twimg.com/profile_images"]
AVATAR_URL_MARKERS = [
    "avatar", "gravatar", "profile-pic", "profile_pic", "profile-photo", "profile_photo", "profilephoto", "headshot", "userpic", "user-pic",
    "/author/", "/authors/", "/byline", "/contributor", "/people/",
]
AVATAR_ALT_MARKERS = ["avatar", "profile photo", "profile picture", "headshot", "portrait of", "photo of ", "picture of "]
CHROME_URL_MARKERS = [
    "logo", "wordmark", "favicon", "/icons/", "icon-", "-icon", "_icon", "sprite", "badge", "spacer", "placeholder",
    "social-", "share-", "button", "arrow", "chevron", "bullet",
]
CHROME_ALT_MARKERS = ["logo", "icon", "wordmark"]
PROMO_URL_MARKERS = ["/ads/", "/ad-", "advert", "sponsor", "promo", "banner", "newsletter", "subscribe", "cta-"]
SQUARE_MAX_EDGE, SQUARE_TOLERANCE, PIXEL_MAX_EDGE = 400, 0.12, 2

# Limits of media.
UNPUBLISHABLE_FORMATS = ["svg", "svgz", "ico", "bmp", "tif", "tiff"]
REFERENCE_ONLY_PROVIDERS = ["youtube", "twitter", "x", "instagram", "tiktok", "facebook"]
VISUAL_TYPES = ["image", "gif", "infographic", "chart", "thumbnail"]
MIN_EDGE = 200
MAX_PHOTO_BYTES, MAX_VIDEO_BYTES = 10 * 1024 * 1024, 50 * 1024 * 1024
MAX_VIDEO_DOWNLOAD_BYTES = 200 * 1024 * 1024
MAX_EDGE_SUM, MIN_PHOTO_RATIO, MAX_PHOTO_RATIO, MAX_GROUP = 10000, 0.2, 20.0, 10
MAX_VISION_BYTES = 4 * 1024 * 1024
HAMMING_THRESHOLD, LOOKBACK_DAYS, EMBEDDING_THRESHOLD = 8, 30, 0.92

# Query parameters that only track.
TRACKING_PREFIXES = ["utm_", "fbclid", "gclid", "ref", "ito", "icid", "cmpid"]

# Markers that a delivery network puts behind a picture's name, in the order in which they go.
RENDITION_MARKERS = (
    r"(?i)\.(width|height|max|min|fill|crop|scale|resize)-\d+(x\d+)?$",
    r"(?i)\.(width|height|max|min|fill|crop|scale|resize)$",
    r"(?i)\.format-[a-z0-9]+$",
    r"(?i)\.[0-9a-f]{6,40}$",
    r"[-_]\d{2,4}x\d{2,4}$",
    r"(?i)@\d+x$",
    r"(?i)[-_](thumb|thumbnail|small|medium|large|scaled|preview|resized)$",
)
MIN_STEM, MIN_TRUNCATION = 8, 12

# Rules of a channel where it states none.
CHANNEL_RULES = {
    "min_publish_interval_minutes": 15, "max_publish_interval_minutes": 30, "publish_backlog_saturation_count": 5, "pace_to_end_of_day": True,
    "max_images": 4, "prefer_video": True, "allow_media_group": True, "min_quality_score": 0.35, "min_news_priority_score": 0.20,
}

# Queues by worker pool.
QUEUES = {
    "pipeline": "news-fetch news-parse media-extraction media-download image-analysis media-selection media-processing duplicate-detection".split(),
    "video": ["video-processing"],
    "publishing": ["telegram-publishing"],
}
