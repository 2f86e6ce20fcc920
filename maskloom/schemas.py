"""Table schemas, the class taxonomy and the band and modality registries."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, codes and field orders shared with the data on disk.
BANDS = ("r", "g", "b", "th", "nir")
BAND_NAMES = ("red", "green", "blue", "thermal", "nir")
CLASS_NAMES = ("background", "water", "snow_ice", "wet_ground")
BACKGROUND, WATER, SNOW_ICE, WET_GROUND, IGNORE = 0, 1, 2, 3, 255
MODALITIES = {
    "fiveband": ("r", "g", "b", "th", "nir"),
    "rgb_std": ("r", "g", "b"),
    "rgb_nofilt": ("r", "g", "b"),
    "lwir": ("th",),
    "nir": ("nir",),
    "rgb_nir": ("r", "g", "b", "nir"),
    "rgb_thermal": ("r", "g", "b", "th"),
}
REPLACED_OPTICS = "rgb_nofilt"
RASTER_NAMES = ("color_preserved_5_band.tiff", "final_5_band.tiff")
PRUNED_FOLDERS = (".git", ".venv", "venv", "node_modules", "site-packages", "__pycache__", "work")
ROUTES = ("auto_accepted", "auto_edited", "interactive_clicks", "manual_from_scratch",
          "rejected", "empty")
GOLD_ROUTES = ("auto_accepted", "auto_edited", "interactive_clicks", "manual_from_scratch")
AGREEMENT_ROUTES = ("auto_accepted", "auto_edited", "manual_from_scratch")
EVAL_SETS = ("reward", "test")
NORMALISATIONS = ("minmax", "meanstd", "percentile")
RESAMPLINGS = ("area", "bilinear")
LOG_FIELDS = (
    "timestamp", "annotator", "scene_id", "scene_dir", "route", "seed_backend", "backend_params",
    "auto_water_pct", "final_water_pct", "auto_vs_final_iou", "edited_pixel_frac",
    "active_seconds", "n_strokes", "n_undos", "seg_mean_entropy", "seg_low_conf_frac",
    "ensemble_agreement", "ensemble_disagreement_frac", "n_backends_run", "features_json",
    "n_clicks", "mask_path", "seg_model", "review_seconds", "eval_set",
)
PROVENANCE_FIELDS = (
    "split", "stem", "scene_dir", "route", "seed_backend", "n_annotators", "auto_vs_final_iou",
    "edited_pixel_frac", "active_seconds", "ensemble_agreement", "ensemble_disagreement_frac",
    "annotator", "timestamp",
)
MANIFEST_FIELDS = ("scene_dir", "tiff_path", "autolabel_status", "mask_path", "water_pct",
                   "review_status", "updated")
SCENE_MANIFEST_FIELDS = (
    "split", "fold", "group", "stem", "scene_dir", "tiff_path", "mask_path", "route",
    "seed_backend", "n_annotators", "auto_vs_final_iou", "edited_pixel_frac", "active_seconds",
    "annotator", "timestamp",
)

_LOG_TYPES = {
    "timestamp": T.TimestampNTZType(),
    **{k: T.DoubleType() for k in (
        "auto_water_pct", "final_water_pct", "auto_vs_final_iou", "edited_pixel_frac",
        "active_seconds", "seg_mean_entropy", "seg_low_conf_frac", "ensemble_agreement",
        "ensemble_disagreement_frac", "review_seconds")},
    **{k: T.LongType() for k in ("n_strokes", "n_undos", "n_backends_run", "n_clicks")},
}
DECISION_LOG = T.StructType(
    [T.StructField(f, _LOG_TYPES.get(f, T.StringType())) for f in LOG_FIELDS])
MANIFEST = T.StructType(
    [T.StructField(f, T.DoubleType() if f == "water_pct" else T.StringType())
     for f in MANIFEST_FIELDS])
EXCLUSIONS = T.StructType(
    [T.StructField(f, T.StringType())
     for f in ("scene_id", "timestamp", "scope", "reason", "decided")])
# One row per pixel; h and w are the frame size, so an operator never has to scan for it.
PIXELS = T.StructType(
    [T.StructField("scene_id", T.LongType(), False)]
    + [T.StructField(c, T.IntegerType(), False) for c in ("h", "w", "y", "x")]
    + [T.StructField(c, T.ShortType()) for c in BANDS])
MASK = T.StructType(
    [T.StructField("scene_id", T.LongType(), False), T.StructField("source", T.StringType(), False)]
    + [T.StructField(c, T.IntegerType(), False) for c in ("h", "w", "y", "x")]
    + [T.StructField("cls", T.ShortType(), False)])
AUTO_MASK_RESULTS = T.StructType([
    T.StructField("scene", T.StringType()), T.StructField("split", T.StringType()),
    T.StructField("backend", T.StringType()), T.StructField("elapsed_s", T.DoubleType()),
    T.StructField("error", T.StringType()), T.StructField("water_frac", T.DoubleType()),
    T.StructField("iou_vs_gold", T.DoubleType())])
RUN_EVENTS = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("pos", T.LongType()),
    T.StructField("event", T.StringType()), T.StructField("step", T.LongType()),
    T.StructField("epoch", T.LongType()), T.StructField("loss", T.DoubleType()),
    T.StructField("lr", T.DoubleType()), T.StructField("miou", T.DoubleType()),
    T.StructField("iou_water", T.DoubleType()), T.StructField("best", T.BooleanType()),
    T.StructField("best_miou", T.DoubleType()), T.StructField("msg", T.StringType())])
CAPTURE_METADATA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("output_files", T.MapType(T.StringType(), T.StringType())),
    T.StructField("image_info", T.StructType([
        T.StructField(k, T.StructType([
            T.StructField("path", T.StringType()),
            T.StructField("shape", T.ArrayType(T.IntegerType())),
            T.StructField("dtype", T.StringType()),
            T.StructField("size_mb", T.DoubleType()),
            T.StructField("channels", T.IntegerType())])) for k in ("nir_off", "nir_on", "lwir")]
        + [T.StructField("output_shape", T.ArrayType(T.IntegerType())),
           T.StructField("registration_transform", T.ArrayType(T.DoubleType()))])),
    T.StructField("processing_parameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("band_descriptions", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])
