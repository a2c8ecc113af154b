"""Fixed values.

Everything in this module is a constant whose exact value decides the result of an operator: prompt texts, keyword
lists, band catalogs, normalisation statistics, error precedence, registries and caps. They are kept together, in their
natural order, and are only ever turned into literals or small broadcast tables.
"""

from __future__ import annotations

# --- Fixed values: instruction prompts by task type ------------------------------------------------------------------
PROMPT_TEMPLATES = {
    "binary": (
        "<image>\nYou are a remote sensing expert analyzing a satellite image. "
        "Answer the following yes/no question based on what you observe.\n"
        "Question: {input}\n"
        "Answer with 'yes' or 'no'."
    ),
    "mcq": (
        "<image>\nYou are a remote sensing expert analyzing a satellite image. "
        "Answer the following multiple-choice question.\n"
        "{input}\n"
        "Respond with only the letter of the correct answer."
    ),
    "captioning": (
        "<image>\nYou are a remote sensing expert. "
        "Describe this satellite image in detail, including the land cover types, "
        "their spatial arrangement, and notable features."
    ),
    "bounding box": (
        "<image>\nYou are a remote sensing expert. "
        "Locate the following in the satellite image and provide bounding box coordinates.\n"
        "Instruction: {input}"
    ),
}

# --- Fixed values: annotation caps by task type (None keeps every row) -----------------------------------------------
TYPE_CAPS = {"captioning": None, "binary": 100_000, "mcq": 80_000, "bounding box": 60_000}

# --- Fixed values: phrases that reveal the task type of a rendered prompt, first hit wins ----------------------------
PROMPT_TYPE_PHRASES = [
    ("binary", "yes/no question"),
    ("mcq", "multiple-choice"),
    ("captioning", "Describe this satellite"),
    ("bounding box", "bounding box"),
]

# --- Fixed values: audit task-type phrases (matched on the lower-cased question) -------------------------------------
AUDIT_MCQ_PHRASES = ["respond with only the letter", "multiple-choice"]
AUDIT_DESCRIPTION_PHRASES = ["describe", "what does", "explain", "summarize", "write a"]
AUDIT_OPEN_PHRASES = ["what type", "what kind", "what are", "what is", "how many", "which"]

# --- Fixed values: unsupported-claim word lists ----------------------------------------------------------------------
COUNTRY_WORDS = [
    "serbia", "portugal", "finland", "india", "germany", "france", "spain", "uk", "italy", "china", "belgium",
    "romania",
]
SEASON_WORDS = ["summer", "winter", "spring", "autumn", "fall", "season"]
MEASUREMENT_WORDS = ["square meter", "hectare", "km2", "sqm", "sq m", "square km"]

# --- Fixed values: land-cover words counted in captions --------------------------------------------------------------
CAPTION_KEYWORDS = [
    "urban", "forest", "agricultural", "water", "residential", "vegetation", "road", "building", "crop", "grass",
    "industrial", "river", "lake", "field", "meadow", "pasture", "woodland",
]

# --- Fixed values: controller intent rules, in order, matched as substrings ------------------------------------------
INTENT_RULES = [
    ("change", ["change", "changed", "difference", "differences", "between", "before and after", "temporal",
                "development over time"]),
    ("fusion", ["sar", "optical", "combine", "fusion", "complementary", "both modalities", "cross-modal"]),
    ("grounding", ["where", "locate", "location", "find", "detect all", "bounding box", "bounding boxes", "mark",
                   "highlight", "near the"]),
    ("caption", ["caption", "summarize the image", "give me a caption"]),
    ("vqa", ["is there", "are there", "how many", "what type", "what kind", "does the image", "which", "what is",
             "what are", "can you identify"]),
]
BI_TEMPORAL_WORDS = ["change", "changed", "difference", "between", "before", "after"]
CROSS_MODAL_WORDS = ["sar", "optical"]
STRICT_SCOPES = {"change": "bi_temporal", "fusion": "cross_modal"}

# --- Fixed values: word-bounded intent patterns of the interactive client --------------------------------------------
CLIENT_GROUNDING_PATTERN = (
    r"\b(high?ligh?t|hightlight|hilight|heighlight|highlite|locate|mark|find|where|show|draw|outline|bbox|bounding|"
    r"detect|detection|spot|search|point|identify|grounding|segment|segmentation|mask|water body|water bodies|"
    r"water detection|building detection|house detection|structure detection|how many|count|amount|number of|"
    r"how much|quantity)\b"
)
CLIENT_FUSION_PATTERN = r"\b(sar|radar|fusion|optical.*sar|sar.*optical|sentinel-1|s1)\b"
CLIENT_FUSION_PAIR_PATTERN = r"\b(fusion|optical.*sar|sar.*optical|s1.*s2|s2.*s1)\b"
CLIENT_RADAR_FILE_PATTERN = r"\b(sar|s1|radar)\b"
CLIENT_OPTICAL_FILE_PATTERN = r"\b(optical|s2|rgb|hand)\b"
CLIENT_CHANGE_PATTERN = r"\b(change|before|after|compare|difference|temporal|between)\b"
CLIENT_CAPTION_PATTERN = r"\b(caption|summarize the image|give me a caption)\b"

# --- Fixed values: tool registry (task, endpoint, required scope, description) ---------------------------------------
TOOL_REGISTRY = [
    ("vqa", "/vqa", "single", "Remote-sensing visual question answering"),
    ("caption", "/caption", "single", "Remote-sensing image captioning from structured perception facts"),
    ("grounding", "/grounding", "single", "Spatial grounding / bounding boxes"),
    ("change", "/change", "bi_temporal", "Bi-temporal change detection"),
    ("fusion", "/fusion", "cross_modal", "Optical-SAR complementary information fusion"),
]

# --- Fixed values: response sections -----------------------------------------------------------------------------
RESPONSE_SECTIONS = [
    ("optical", "OPTICAL EVIDENCE:"),
    ("sar", "SAR EVIDENCE:"),
    ("fused", "FUSED ANALYSIS:"),
    ("disagreements", "DISAGREEMENTS:"),
]

# --- Fixed values: radar properties by land-cover category -----------------------------------------------------------
RADAR_PROPERTIES = {
    "urban": {
        "backscatter": "high",
        "mechanism": "double-bounce scattering from buildings and vertical structures",
        "texture": "heterogeneous with bright spots from corner reflectors",
        "moisture": "low (impervious surfaces)",
        "keywords": ["urban", "built-up", "residential", "industrial", "commercial"],
    },
    "water": {
        "backscatter": "very low",
        "mechanism": "specular reflection away from sensor",
        "texture": "smooth and dark with uniform low returns",
        "moisture": "high (water surface)",
        "keywords": ["water", "river", "lake", "sea", "pond", "reservoir"],
    },
    "forest": {
        "backscatter": "moderate to high",
        "mechanism": "volume scattering from canopy structure and branches",
        "texture": "rough texture with moderate variability",
        "moisture": "moderate (canopy interception)",
        "keywords": ["forest", "woodland", "broad-leaved", "coniferous", "mixed forest"],
    },
    "crop": {
        "backscatter": "variable (depends on growth stage)",
        "mechanism": "surface scattering when bare, volume scattering when mature",
        "texture": "regular geometric patterns from field boundaries",
        "moisture": "variable (irrigation dependent)",
        "keywords": ["crop", "agricultural", "arable", "permanently irrigated", "rice"],
    },
    "grassland": {
        "backscatter": "low to moderate",
        "mechanism": "surface scattering from short vegetation",
        "texture": "relatively smooth and homogeneous",
        "moisture": "moderate",
        "keywords": ["grass", "pasture", "meadow", "natural grassland"],
    },
    "bare": {
        "backscatter": "low to moderate (roughness dependent)",
        "mechanism": "surface scattering controlled by soil roughness",
        "texture": "smooth to moderately rough",
        "moisture": "variable (exposed soil)",
        "keywords": ["bare", "rock", "sand", "sparse vegetation", "burnt"],
    },
    "wetland": {
        "backscatter": "mixed (high from emergent vegetation over water)",
        "mechanism": "double-bounce between water surface and vegetation stems",
        "texture": "heterogeneous with bright patches over flooded areas",
        "moisture": "very high (saturated soil or standing water)",
        "keywords": ["wetland", "marsh", "bog", "peat", "inland marsh"],
    },
    "shrub": {
        "backscatter": "moderate",
        "mechanism": "mixed surface and volume scattering",
        "texture": "moderately rough with scattered bright returns",
        "moisture": "low to moderate",
        "keywords": ["shrub", "moor", "heathland", "sclerophyllous", "transitional"],
    },
}

# --- Fixed values: radar question templates (input, output, type, category; {n...} fields name the negative) ---------
RADAR_QA_TEMPLATES = [
    ("Does the SAR radar data show {backscatter} backscatter levels in this area?", "Yes", "binary", "sar_{cat}"),
    ("Based on the radar signal, is there evidence of {mechanism}?", "Yes", "binary", "sar_{cat}"),
    ("Does the SAR data indicate {negative_mechanism}?", "No", "binary", "sar_{cat}_negative"),
    ("What does the SAR radar backscatter pattern reveal about the surface in this image?",
     "The SAR data shows {backscatter} backscatter intensity, consistent with {mechanism}. "
     "The radar texture appears {texture}. Moisture indicators suggest {moisture} conditions.",
     "descriptive", "sar_{cat}"),
    ("Describe the surface characteristics visible in the radar data.",
     "The radar imagery reveals {texture}. The backscatter level is {backscatter}, indicating {mechanism}. "
     "Surface moisture appears {moisture}.",
     "descriptive", "sar_{cat}"),
    ("How do the optical and SAR observations complement each other for this area?",
     "The optical data provides spectral information about surface materials and vegetation health through "
     "reflectance bands. The SAR data complements this with {backscatter} backscatter revealing {mechanism}. "
     "Together, they give a more complete picture: optical shows what the surface looks like, while SAR reveals its "
     "physical structure and moisture state ({moisture}).",
     "descriptive", "fusion_{cat}"),
]

# --- Fixed values: fusion question templates by family ---------------------------------------------------------------
FUSION_TEMPLATES = {
    "compare_modalities": [
        ("Compare what the optical and SAR observations reveal about this area.",
         "The optical imagery provides spectral information about surface materials, vegetation health through "
         "reflectance bands, and color-based land cover discrimination. The SAR radar data complements this with "
         "information about surface structure, roughness, and moisture content through backscatter intensity. "
         "Together, the fused observations provide a more complete understanding than either modality alone."),
        ("What are the differences between the optical and radar observations?",
         "The optical bands capture reflected sunlight, showing vegetation greenness, water color, and surface "
         "albedo. The SAR radar measures microwave backscatter, which reveals surface texture, structural features "
         "like buildings, and moisture levels independent of cloud cover or lighting conditions. These complementary "
         "views allow for more robust land cover classification."),
    ],
    "sar_advantage": [
        ("What additional information does the SAR radar provide beyond optical imagery?",
         "SAR provides structural information that optical imagery cannot: surface roughness through backscatter "
         "texture, building detection through double-bounce scattering, water surface detection through specular "
         "reflection, and soil moisture estimation. SAR also works regardless of cloud cover, illumination, and time "
         "of day, making it essential for all-weather monitoring."),
        ("In what situations would SAR radar be more useful than optical imagery?",
         "SAR is more useful than optical in several situations: detecting water bodies (very low backscatter from "
         "specular reflection), identifying urban structures (double-bounce from buildings), monitoring soil "
         "moisture, mapping flood extent under vegetation, and any scenario with cloud cover or nighttime conditions "
         "where optical sensors cannot acquire useful data."),
    ],
    "optical_advantage": [
        ("When does optical imagery provide stronger evidence than SAR?",
         "Optical imagery is stronger for vegetation species discrimination (through narrow spectral bands), crop "
         "type identification, water quality assessment, mineral/soil composition mapping, and any task requiring "
         "fine color or spectral differentiation. The multispectral bands (visible, near-infrared, shortwave "
         "infrared) each highlight different surface properties that SAR's two polarizations cannot distinguish."),
    ],
    "fusion_benefit": [
        ("How does combining optical and SAR observations improve accuracy?",
         "Multimodal fusion improves accuracy by providing complementary information: optical contributes spectral "
         "discrimination while SAR adds structural and textural context. For example, a bare field and a young crop "
         "field may look similar in SAR but differ spectrally in optical; conversely, shadows in optical imagery can "
         "be resolved using SAR backscatter. The combined information reduces ambiguity and improves classification "
         "confidence."),
        ("Why is multi-sensor fusion important for Earth observation?",
         "Multi-sensor fusion combines the strengths of different sensors: optical provides rich spectral information "
         "for material and vegetation identification, while SAR provides all-weather, day-night structural and "
         "moisture information. By fusing both, we achieve more robust, accurate, and temporally complete Earth "
         "observation than any single sensor can provide."),
    ],
}

# --- Fixed values: fusion questions tied to one land cover -----------------------------------------------------------
LANDCOVER_FUSION_TEMPLATES = {
    "water": (
        "Which modality provides stronger evidence for water detection in this image?",
        "Both modalities contribute to water detection. SAR shows very low backscatter from specular reflection off "
        "calm water surfaces, making water bodies appear dark. Optical imagery shows characteristic blue/dark "
        "spectral signatures. The combination is especially valuable for detecting water under vegetation or "
        "distinguishing water from shadows."),
    "urban": (
        "How do the modalities differ in urban area detection?",
        "Urban areas show distinctive signatures in both modalities. In SAR, buildings cause strong double-bounce "
        "scattering, appearing as bright spots with high backscatter. In optical imagery, built-up areas show "
        "characteristic spectral signatures from concrete, asphalt, and metal. Combining both provides robust urban "
        "mapping that handles shadows and cloud cover."),
    "forest": (
        "What do the different sensors reveal about the forested areas?",
        "Optical imagery reveals forest type through spectral signatures: broad-leaved versus coniferous forests show "
        "different near-infrared reflectance patterns. SAR adds information about canopy structure through volume "
        "scattering, tree height estimation, and biomass. The fusion provides both species-level classification from "
        "optical and structural characterization from radar."),
    "agricultural": (
        "How do optical and SAR complement each other for agricultural monitoring?",
        "Optical bands enable crop type identification through vegetation indices like NDVI, while SAR tracks crop "
        "growth stages through changing backscatter patterns (bare soil to mature crop). SAR is particularly valuable "
        "during cloudy seasons when optical data is unavailable. Together they enable continuous, accurate crop "
        "monitoring."),
}

# --- Fixed values: optical band catalog (name, description, wavelength nm, native resolution m) ----------------------
OPTICAL_BANDS = [
    ("B01", "Coastal Aerosol", 443, 60),
    ("B02", "Blue", 490, 10),
    ("B03", "Green", 560, 10),
    ("B04", "Red", 665, 10),
    ("B05", "Red Edge 1", 705, 20),
    ("B06", "Red Edge 2", 740, 20),
    ("B07", "Red Edge 3", 783, 20),
    ("B08", "NIR", 842, 10),
    ("B8A", "Narrow NIR", 865, 20),
    ("B09", "Water Vapor", 945, 60),
    ("B10", "Cirrus", 1375, 60),
    ("B11", "SWIR 1", 1610, 20),
    ("B12", "SWIR 2", 2190, 20),
]
PACKED_BANDS = ["B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12"]
RADAR_CHANNELS = ["VV", "VH"]
GRID_PRIORITY = ["B02", "B03", "B04", "B08"]

# --- Fixed values: per-band normalisation statistics (mean, standard deviation) --------------------------------------
OPTICAL_STATS = {
    "B01": (361.0767822265625, 575.0687255859375),
    "B02": (438.3720703125, 607.02685546875),
    "B03": (614.0556640625, 603.2968139648438),
    "B04": (588.4096069335938, 684.56884765625),
    "B05": (942.8433227539062, 738.4326782226562),
    "B06": (1769.931640625, 1100.4560546875),
    "B07": (2049.551513671875, 1275.805419921875),
    "B08": (2193.2919921875, 1369.3717041015625),
    "B8A": (2235.556640625, 1356.5440673828125),
    "B09": (2241.455322265625, 1316.393310546875),
    "B10": (0.0, 1.0),
    "B11": (1568.226806640625, 1070.1612548828125),
    "B12": (997.7324829101562, 813.5276489257812),
}
RADAR_STATS = {"VV": (-12.644, 5.133), "VH": (-19.353, 5.591)}
RADAR_RANGES = {"VV": (-25.0, 5.0), "VH": (-35.0, -5.0)}
RADAR_CLIP_DB = (-30.0, 5.0)

# --- Fixed values: band names assumed from the band count ------------------------------------------------------------
BANDS_BY_COUNT = {
    3: ["B04", "B03", "B02"],
    4: ["B04", "B03", "B02", "B08"],
    12: ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12"],
    13: ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B10", "B11", "B12"],
}

# --- Fixed values: spectral index band pairs (name, first band, second band) -----------------------------------------
SPECTRAL_INDICES = [("NDVI", "B08", "B04"), ("NDWI", "B03", "B08"), ("NDBI", "B11", "B08")]

# --- Fixed values: image metadata vocabulary -------------------------------------------------------------------------
MODALITIES = ["optical", "sar", "multispectral", "hyperspectral", "elevation", "other"]
OPTICAL_MODALITIES = ["optical", "multispectral", "hyperspectral"]
FILE_FORMATS = ["GEOTIFF", "TIFF", "PNG", "JPEG"]
TIFF_ALIASES = ["GEOTIFF", "GEO_TIFF", "GTIF", "TIF", "TIFF"]
RASTER_EXTENSIONS = [".tif", ".tiff", ".geotiff", ".gtif", ".png", ".jpg", ".jpeg"]
BENCHMARK_DATASETS = ["VRSBench", "RSVQA", "CDVQA", "BigEarthNet"]
WGS84_ALIASES = ["WGS 84", "WGS84", "CRS:84", "OGC:CRS84", "4326", "EPSG:4326", "WGS 84 (GEOGRAPHIC LAT/LON)"]
MERCATOR_ALIASES = ["WGS 84 / PSEUDO-MERCATOR", "WEB MERCATOR", "3857", "EPSG:3857", "EPSG:900913"]

# --- Fixed values: GeoKey ids ----------------------------------------------------------------------------------------
GEOKEY_PROJECTED = 3072
GEOKEY_GEOGRAPHIC = 2048
GEOKEY_USER_DEFINED = 32767

# --- Fixed values: order in which validation errors are reported -----------------------------------------------------
ERROR_PRECEDENCE = [
    "INVALID_FORMAT",
    "UNSUPPORTED_BENCHMARK_FORMAT",
    "UNREADABLE_RASTER",
    "INCOMPATIBLE_MODALITY",
    "MISSING_CRS",
    "UNSUPPORTED_CRS",
    "DIMENSION_MISMATCH",
    "INVALID_BAND_CONFIGURATION",
    "MISSING_BAND",
    "RESOLUTION_MISMATCH",
    "SPATIAL_MISMATCH",
    "COREGISTRATION_FAILURE",
    "INVALID_CLOUD_COVER",
    "MISSING_REQUIRED_METADATA",
]

# --- Fixed values: response contracts (required field -> kind) -------------------------------------------------------
RESPONSE_CONTRACTS = {
    "vqa": ["answer", "confidence", "provenance"],
    "caption": ["caption", "confidence", "provenance"],
    "grounding": ["boxes", "expression", "confidence", "provenance"],
    "change": ["description", "change_detected", "confidence", "provenance"],
    "fusion": ["fused_answer", "modality_attribution", "confidence", "provenance"],
}
FUSION_ATTRIBUTION_FIELDS = ["optical_evidence", "sar_evidence", "fused_reasoning"]

# --- Fixed values: JSON schemas of the five responses ----------------------------------------------------------------
_STRING, _NUMBER, _OBJECT, _BOOLEAN = ({"type": t} for t in ("string", "number", "object", "boolean"))
_BOXES = {"type": "array", "items": {"$ref": "BoundingBox"}}
_ALWAYS = {"confidence": {"$ref": "Confidence"}, "provenance": {"$ref": "Provenance"}, "execution_time_ms": _NUMBER}
SCHEMA_DEFINITIONS = {
    "Confidence": {
        "type": "object", "required": ["score"],
        "properties": {"score": {"type": "number", "minimum": 0.0, "maximum": 1.0}, "method": _STRING, "factors": _OBJECT},
    },
    "BoundingBox": {
        "type": "object", "required": ["x_min", "y_min", "x_max", "y_max"],
        "properties": {
            "x_min": _NUMBER, "y_min": _NUMBER, "x_max": _NUMBER, "y_max": _NUMBER, "label": _STRING, "confidence": _NUMBER,
        },
    },
    "Provenance": {
        "type": "object", "required": ["model_name"],
        "properties": {
            "model_name": _STRING, "checkpoint_version": _STRING, "input_hash": _STRING, "timestamp": _STRING,
            "preprocessing": _OBJECT,
        },
    },
    "ModalityAttribution": {
        "type": "object", "required": FUSION_ATTRIBUTION_FIELDS,
        "properties": {"optical_evidence": _STRING, "sar_evidence": _STRING, "fused_reasoning": _STRING},
    },
}
RESPONSE_SCHEMAS = {
    "vqa": {
        "type": "object", "required": RESPONSE_CONTRACTS["vqa"],
        "properties": {"answer": _STRING, "evidence_regions": _BOXES, **_ALWAYS},
    },
    "caption": {
        "type": "object", "required": RESPONSE_CONTRACTS["caption"], "properties": {"caption": _STRING, **_ALWAYS},
    },
    "grounding": {
        "type": "object", "required": RESPONSE_CONTRACTS["grounding"],
        "properties": {"boxes": _BOXES, "expression": _STRING, **_ALWAYS},
    },
    "change": {
        "type": "object", "required": RESPONSE_CONTRACTS["change"],
        "properties": {
            "description": _STRING, "answer": {"type": ["string", "null"]}, "change_detected": _BOOLEAN, "change_regions": _BOXES,
            **_ALWAYS,
        },
    },
    "fusion": {
        "type": "object", "required": RESPONSE_CONTRACTS["fusion"],
        "properties": {
            "fused_answer": _STRING, "modality_attribution": {"$ref": "ModalityAttribution"}, "optical_evidence_overlay": _OBJECT,
            "sar_evidence_overlay": _OBJECT, "disagreement_flag": _BOOLEAN, "disagreement_details": _STRING, **_ALWAYS,
        },
    },
}

# --- Fixed values: claim markers looked for in served answers --------------------------------------------------------
CLAIM_MARKERS = ["Finland", "Ireland", "spring", "climate zone", "square meters", "square kilometres", "hectares"]


def supported_epsg_codes() -> list[int]:
    """Supported codes from their rule: two global systems, every northern UTM zone and some southern ones."""
    return (
        [4326, 3857]
        + list(range(32601, 32661))
        + list(range(32701, 32711))
        + list(range(32732, 32741))
        + [32743]
    )
