"""Training-data operators: filtering, deduplication, extraction, decontamination and mixing.

Nothing outside this subpackage imports its operators; the containment join uses kernels of ``folio.llm.common``. ``folio.llm.queries`` registers its queries.
"""
