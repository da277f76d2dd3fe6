"""Written tables in the folder that all executors share."""

from docquery.sources.scratch import fresh_path, shared_folder, written

__all__ = ["fresh_path", "shared_folder", "written"]
