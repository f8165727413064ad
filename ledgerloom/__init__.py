"""Invoice-line classification and its evaluation, as Spark DataFrame operators."""

from ledgerloom.functions.parsing import parse_json_response, parse_line_response
from ledgerloom.functions.text import (
    add_model_text_column,
    add_terms,
    create_novel_items,
    normalize_text,
    tokens,
)
from ledgerloom.functions.vectors import TrainedVectors, hashed_embedding
from ledgerloom.operators.approximate import approximate_knn
from ledgerloom.operators.asof import as_of_join
from ledgerloom.operators.boilerplate import boilerplate_terms, strip_terms, term_label_entropy
from ledgerloom.operators.clusters import kmeans_centres, nearest_centre
from ledgerloom.operators.components import connected_components
from ledgerloom.operators.errors import (
    confusion_topk,
    error_field_shares,
    error_report,
    error_rows,
    majority_collapse,
    supplier_errors,
    wrong_field_histogram,
)
from ledgerloom.operators.inference import batch_embed, batch_infer, fallback_labels, with_truth
from ledgerloom.operators.kept_index import SemanticIndex
from ledgerloom.operators.labels import (
    balanced_weights,
    build_label_vocab,
    dataset_profile,
    decode_labels,
    encode_labels,
    label_vocabulary,
    null_label_counts,
)
from ledgerloom.operators.metrics import (
    class_report,
    error_rate,
    evaluate_predictions,
    field_metrics,
    metric_cube,
    sample_wise_f1,
)
from ledgerloom.operators.monitoring import (
    confidence_counts,
    distribution_distance,
    kept_counts,
    late_rows,
    stream_confidence_counts,
)
from ledgerloom.operators.prompts import build_few_shot_block, chat_prompt, plain_prompt
from ledgerloom.operators.results import (
    best_method,
    improvement,
    leaderboard,
    method_scores,
    target_check,
    union_results,
    winner_fields,
)
from ledgerloom.operators.retrieval import build_index, knn, nested_examples, retrieve, search
from ledgerloom.operators.split import (
    Split,
    group_split,
    prepare_multilabel_data,
    random_split,
    semantic_holdout_split,
    stratified_folds,
    stratified_random_split,
)
from ledgerloom.operators.suppliers import canonical_suppliers, name_links
from ledgerloom.operators.tfidf import Tfidf, TfidfSettings, tfidf_vocabulary, tfidf_weights
from ledgerloom.operators.vote import vote
from ledgerloom.plans.experiments import (
    classify_novel_items,
    evaluate_field,
    evaluate_lines,
    result_table,
    retrieval_experiment,
    tfidf_experiment,
    vector_experiment,
)
from ledgerloom.plans.models import ForestSettings, LogisticSettings, MlClassifier
from ledgerloom.plans.tuning import MacroF1Evaluator, grid_search_tfidf, random_search_embeddings
from ledgerloom.session import ship_package
from ledgerloom.sources.lines import (
    load_and_prepare_data,
    load_raw_df,
    with_line_id,
    write_error_report,
)

__all__ = [name for name in dir() if not name.startswith("_")]
