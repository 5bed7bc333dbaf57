"""Schemas of labels, results and recognised boxes."""

ELEMENT = "struct<type:string,bbox:array<int>,text:string,icon_name:string,selected:boolean,truncated:boolean,color_class:string,size_class:string>"
LABELS = f"image_path string, pattern string, language string, background string, canvas_size array<int>, elements array<{ELEMENT}>, raw_text string"
#: Labels that may have the short form {image, text} as well.
LABELS_ANY = f"{LABELS}, image string, text string"
RESULTS = "image_path string, model string, language string, pattern string, background string, ref string, hyp string, cer double, wer double, elapsed_ms double"
APP_RESULTS = "filename string, image_path string, cer double, verdict string, n_boxes int, mean_score double, reference string, prediction string"
BOXES = "array<struct<bbox:array<array<double>>,text:string,score:double>>"
POLYGONS = "array<struct<transcription:string,points:array<array<int>>>>"
IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp", "webp", "tif", "tiff")
