"""What a Python worker keeps."""

from postmill.llm import worker_memory


def test_one_object_is_kept_at_a_time():
    built = []

    @worker_memory.kept
    def first(name):
        built.append(name)
        return [name]

    @worker_memory.kept
    def second(name):
        return {name}

    one = first("a")
    assert first("a") is one and built == ["a"]
    assert second("a") == {"a"}
    assert first("a") is not one and built == ["a", "a"]
    worker_memory.release()
    assert first("a") == ["a"] and len(built) == 3
