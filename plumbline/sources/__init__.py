from plumbline.sources.tables import Tables

__all__ = ["Tables"]
